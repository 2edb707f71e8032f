"""Nearest neighbours by largest inner product over shifted Hilbert curves.

Equal vectors are one node, so a vector that a large share of all rows holds is searched for, and found, once.

Largest inner products become nearest points by one more coordinate (Bachrach et al., 2014): a vector x is placed at
(x, sqrt(M^2 - |x|^2)), a query q at (M q / |q|, 0). Each of CURVES orderings turns the principal directions of these
points at random, keeps DIMS of them, shifts the grid at random and sorts by Hilbert key; Spark range-partitions the
keys, and every row has its place in each order. The queries of a span of places are scored together against all that
their windows meet, `reach` places to either side; the windows of all curves merge, and the best are ranked by their
exact scores. Large windows are cut into segments, so no task sees more than its part of them.

Directions, curves and reach are fitted on bounded samples: directions on SAMPLE vectors, curves and reach on ASKED
queries, whose true neighbours are found among all rows. Of the reaches for one curve, two, and so on, that would have
found TARGET of these neighbours, the cheapest is taken. So structure in the vectors makes windows small; vectors spread
evenly in all directions have no neighbours in any order, and there windows grow to a large part of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, shelve

CURVES = 8
DIMS = 8
BITS = 8
K = 20
EVERY = 20
SEED = 11
#: Vectors that are scored at a time, and blocks of them that one task scores against the queries of a span at most.
BLOCK, SEGMENT = 2048, 32
#: Bounds of the samples: vectors (and numbers in them) for directions, queries for curves and reach.
SAMPLE, SAMPLE_NUMBERS, ASKED = 20_000, 4_000_000, 256
#: Share of the sampled queries' true neighbours that windows must hold.
TARGET = 0.95


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (n, dims), by Skilling's transposition (2004), as uint64; dims * bits is 64 at most."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & np.uint64(q), t ^ np.uint64(q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << one | (v >> np.uint64(b)) & one
    return key


@dataclass(frozen=True)
class Curves:
    """Where points fall on each curve's grid. top: M of the module's first lines."""

    mean: np.ndarray = field(repr=False)
    bases: tuple[np.ndarray, ...] = field(repr=False)
    spreads: tuple[np.ndarray, ...] = field(repr=False)
    shifts: tuple[np.ndarray, ...] = field(repr=False)
    top: float

    def keys(self, vectors: np.ndarray, curve: int, asked: bool = False) -> np.ndarray:
        """Keys of one curve, as int64 in key order, of vectors or of the queries that they ask."""
        at = (self._points(vectors, asked) - self.mean) @ self.bases[curve]
        # Three standard deviations to either side fill half the grid; the shift places it.
        place = np.clip(at / (6 * self.spreads[curve]) + 0.5, 0, 1) / 2 + self.shifts[curve]
        cells = np.clip((place * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return (hilbert(cells) ^ np.uint64(1 << 63)).view(np.int64)

    def _points(self, v: np.ndarray, asked: bool) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if asked:
            return np.hstack([v * (self.top / norm), np.zeros_like(norm)])
        return np.hstack([v, np.sqrt(np.maximum(self.top**2 - norm**2, 0))])


def fit_curves(sample: np.ndarray, curves: int = CURVES, seed: int = SEED) -> Curves:
    """Principal directions of a sample of vectors (n, d); the first curve takes the largest, each other a turn of them."""
    top = float(np.linalg.norm(sample, axis=1).max()) if len(sample) else 1.0
    one = Curves(np.zeros(sample.shape[1] + 1), (), (), (), top)
    points = one._points(sample, False) if len(sample) else np.zeros((1, sample.shape[1] + 1))
    mean = points.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((points - mean).T, bias=True).reshape(points.shape[1], -1))
    order = np.argsort(-values)[: 2 * DIMS]
    wide, rng = vectors[:, order], np.random.default_rng(seed)
    m = min(DIMS, wide.shape[1])
    bases = [wide[:, :m]] + [wide @ np.linalg.qr(rng.normal(size=(wide.shape[1],) * 2))[0][:, :m] for _ in range(curves - 1)]
    spreads = [np.maximum(((points - mean) @ b).std(axis=0), 1e-12 * max(1.0, top)) for b in bases]
    return Curves(mean, tuple(bases), tuple(spreads), tuple(rng.random(m) / 2 for _ in bases), top)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(col), -1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, always summed in the same order, so equal vectors tie exactly."""
    return np.multiply(a, b).sum(axis=1)


def best(q: np.ndarray, ids: np.ndarray, nodes: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q: largest score, then smallest id, then smallest node."""
    order = np.lexsort((nodes, ids, -scores, q))
    start = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[rank < k]


def top_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k largest inner products of each row of q, in double precision."""
    rough = q @ x.T
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    a, c = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    s = dots(q[a], x[c])
    top = best(a, ids[c], nodes[c], s, k)
    return a[top], c[top], s[top]


def _keyed(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, vec, asked) to (curve, key, q, node): each node once in each curve, and once more as a query."""
        for b in batches:
            if not b.num_rows:
                continue
            v, asked = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for c in range(len(curves.bases)):
                for q, some in ((False, np.ones(len(v), bool)), (True, asked)):
                    if some.any():
                        n = int(some.sum())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, c, np.int32)), pa.array(curves.keys(v[some], c, q)), pa.array(np.full(n, q)),
                                b.column(0).filter(pa.array(some))
                            ],
                            ["curve", "key", "q", "node"],
                        )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (curve, q, node) to (curve, q, node, part, at): vectors of the task before this row."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        data = (~b.column(1).to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
        at = n + np.cumsum(data) - data
        n += int(data.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], ["curve", "q", "node", "part", "at"])


def _against(asked: np.ndarray, vectors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each given query among the nodes (node, id, vec) of each batch."""
        for b in batches:
            if b.num_rows:
                nodes, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                a, c, s = top_of(vectors, _matrix(b.column(2)), ids, nodes, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[a]), pa.array(nodes[c]), pa.array(ids[c]), pa.array(s)], ["asked", "node", "id", "score"])

    return run


def _windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (curve, span, segment, q, node, id, vec) come sorted by the first four: the queries of a span, then the
        vectors of a segment that their windows meet. Held are the queries and the k best of each so far."""
        at, asked, best_of, floor = None, [], None, None

        def found() -> Iterator[pa.RecordBatch]:
            if best_of is not None and len(best_of[0]):
                a, nodes, ids, s = best_of
                yield pa.RecordBatch.from_arrays([pa.array(asked[0][a]), pa.array(nodes), pa.array(ids), pa.array(s)], ["asked", "node", "id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            q, nodes, ids = b.column(3).to_numpy(zero_copy_only=False).astype(bool), b.column(4).to_numpy(), b.column(5).to_numpy()
            v = _matrix(b.column(6))
            starts = np.flatnonzero((np.diff(key, axis=1, prepend=-1) != 0).any(axis=0) | (np.diff(q.astype(np.int8), prepend=-1) != 0))
            for lo, hi in zip(starts, np.append(starts[1:], len(q))):
                if at != tuple(key[:, lo]):
                    yield from found()
                    at, asked, best_of = tuple(key[:, lo]), [], None
                if q[lo]:
                    asked.append((nodes[lo:hi], v[lo:hi]))
                    continue
                if not asked:
                    continue
                if best_of is None:
                    asked = [np.concatenate(x) for x in zip(*asked)]
                    best_of, floor = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, float)], np.full(len(asked[0]), -np.inf)
                for i in range(lo, hi, BLOCK):
                    part = slice(i, min(hi, i + BLOCK))
                    best_of, floor = _better(asked[1], v[part], nodes[part], ids[part], best_of, floor, k)
        yield from found()

    return run


def _better(q: np.ndarray, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, best_of: list, floor: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """The k best (query, node, id, score) of each query so far and among x, and the k-th score of each (-inf before k)."""
    new = [[], [], [], []]
    for lo in range(0, len(q), 512):
        rough = q[lo : lo + 512] @ x.T
        least = floor[lo : lo + 512]
        if x.shape[0] > k:
            least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
        with np.errstate(invalid="ignore"):
            a, c = np.nonzero(rough >= np.where(np.isneginf(least), least, least - 1e-9 * (1 + np.abs(least)))[:, None])
        for to, part in zip(new, (a + lo, nodes[c], ids[c], dots(q[a + lo], x[c]))):
            to.append(part)
    rows = [np.concatenate([old, *parts]) for old, parts in zip(best_of, new)]
    top = best(rows[0], rows[2], rows[1], rows[3], k)
    rows = [x[top] for x in rows]
    full = np.bincount(rows[0], minlength=len(q)) >= k
    last = np.full(len(q), np.inf)
    np.minimum.at(last, rows[0], rows[3])
    return rows, np.where(full, last, -np.inf)


_FOUND = "asked bigint, node bigint, id bigint, score double"


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each `by` with the largest score, then the smallest id, then the smallest node."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id", "node")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, id, vec) of rows that take part: an id; a vector that is not null, not zero, without null or non-finite
    components. row numbers them. Vectors of different lengths are compared as if the shorter ended in zeros."""
    kind = vectors.select(column(vectors, vec_col)).schema[0].dataType.elementType.simpleString()
    number = "float" if kind == "float" else "double"
    v = column(vectors, vec_col).cast(f"array<{number}>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = shelve(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec"))
    longest, shortest = rows.agg(F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if longest == shortest:
        return rows
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast(number), F.lit(longest) - F.size("vec"))))


def reach_of(distances: np.ndarray, block: int, target: float) -> tuple[int, int]:
    """(curves, reach) of least cost that hold the target share. distances: (pairs, curves), in places."""
    if not len(distances):
        return 1, 0
    least = np.minimum.accumulate(distances, axis=1)
    reach = np.sort(least, axis=0)[max(0, int(np.ceil(target * len(least))) - 1)]
    curves = int(np.argmin((np.arange(least.shape[1]) + 1) * (2 * reach + block)))
    return curves + 1, int(reach[curves])


def search(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, exact: bool = False, block: int = BLOCK, target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row whose id is divisible by `every`.

    Nearest first, ties to the smaller id, then to the earlier row; every row but the query's own is a candidate, also
    where ids repeat: rows that share an id stand for themselves, as queries too. Which rows take part: valid_vectors().
    Other columns are ignored. Fewer candidates than k: all of them; an empty table or no query: no rows. exact=True
    makes the windows as large as the table, which finds everything at the cost of all queries times all rows.
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    same = ["h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(SEED), "vec")})
    order = Window.partitionBy(*same).orderBy("id", "row")
    # Of equal vectors the first k + 1 rows can be answers. Spark limits each group before it is shuffled.
    members = rows.withColumns({"place": F.row_number().over(order), "node": F.first("row").over(order)}).where(F.col("place") <= k + 1)
    members = shelve(members.select("node", "id", "row", *same, F.when(F.col("place") == 1, F.col("vec")).alias("vec")))
    heads = members.where("vec IS NOT NULL").select("node", "id", "vec", *same)
    queries = shelve(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("row").alias("query"), *same).join(heads.select(*same, F.col("node").alias("asks")), same).select("query_id", "query", "asks"))
    asked = queries.select(F.col("asks").alias("of")).distinct()
    nodes = shelve(heads.join(asked, F.col("node") == F.col("of"), "left").select("node", "id", "vec", F.col("of").isNotNull().alias("asked")))
    found = _first(_found(nodes, k + 1, exact, block, target), "asked", k + 1)
    near = found.select("asked", F.col("node").alias("of"), "score").join(members.select(F.col("node").alias("of"), "id", F.col("row").alias("node")), "of")
    near = _first(near, "asked", k + 1).select(F.col("asked").alias("of"), "id", "node", "score")
    out = queries.join(near, F.col("asks") == F.col("of")).where("query <> node").select("query_id", "query", "id", "node", "score")
    return _first(out, "query", k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _found(nodes: DataFrame, k: int, exact: bool, block: int, target: float) -> DataFrame:
    """(asked, node, id, score) from the windows of all curves, each node once; k of each query at least, if there are."""
    spark, n = nodes.sparkSession, nodes.count()
    some = nodes.select("vec").limit(1).collect()
    dims = len(some[0].vec) if some else 1
    share = min(1.0, min(SAMPLE, SAMPLE_NUMBERS // dims) / max(1, n))
    sample = nodes.select("vec") if share == 1 else nodes.select("vec").sample(share, seed=SEED)
    sample = sample.toArrow()["vec"].combine_chunks() if n else None
    curves = fit_curves(_matrix(sample) if n and len(sample) else np.zeros((0, dims)))
    ordered = nodes.select("node", "vec", "asked").mapInArrow(_keyed(curves), "curve int, key bigint, q boolean, node bigint")
    ordered = ordered.repartitionByRange("curve", "key", "q", "node").sortWithinPartitions("curve", "key", "q", "node").select("curve", "q", "node")
    placed = shelve(ordered.mapInArrow(_numbered, "curve int, q boolean, node bigint, part int, at bigint"))
    # One row for each partition of the sort.
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count_if(~F.col("q")).alias("n")).collect())
    before = np.cumsum([0, *(x for _, x in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, before[i]) for i, (p, _) in enumerate(sizes)], "part int, before bigint")
    placed = placed.join(F.broadcast(offsets), "part").select("curve", "q", "node", (F.col("before") + F.col("at") - F.col("curve") * F.lit(n)).alias("place"))
    use, reach = (1, n) if exact else reach_of(_distances(nodes, placed, k), block, target)
    span = min(max(block, 4 * reach), 20 * block)
    placed = placed.where(F.col("curve") < use).join(nodes.select("node", "id", "vec"), "node")

    def every(low: Column, high: Column, size: int) -> Column:
        """The numbers of the parts of `size` places that low to high meets."""
        ends = [F.greatest(F.lit(0), F.least(F.lit(max(0, n - 1) // size), F.floor(x / F.lit(size)))) for x in (low, high)]
        return F.explode(F.sequence(*ends))

    place, segment = F.col("place"), SEGMENT * block
    of = F.least(F.floor(place / F.lit(span)), F.lit(max(0, n - 1) // span))
    data = placed.where(~F.col("q")).withColumns({"segment": F.floor(place / F.lit(segment)), "span": every(place - reach, place + reach, span)})
    ask = placed.where("q").withColumn("span", of).withColumn("segment", every(F.col("span") * span - reach, (F.col("span") + 1) * span - 1 + reach, segment))
    names = ["curve", "span", "segment", (~F.col("q")).alias("data"), "node", "id", "vec"]
    work = data.select(*names).unionByName(ask.select(*names)).repartition("curve", "span", "segment").sortWithinPartitions("curve", "span", "segment", "data", "node")
    found = work.select("curve", "span", "segment", (~F.col("data")).alias("q"), "node", "id", "vec").mapInArrow(_windows(k), _FOUND)
    return found if use == 1 else found.groupBy("asked", "node").agg(F.first("id").alias("id"), F.first("score").alias("score"))


def _distances(nodes: DataFrame, placed: DataFrame, k: int) -> np.ndarray:
    """(pairs, curves): places between sampled queries and each of their true k neighbours; ASKED times k pairs at most."""
    some = nodes.where("asked").orderBy(F.xxhash64("node"), "node").limit(ASKED).select("node", "vec").toArrow()
    if not len(some):
        return np.empty((0, CURVES))
    asked, v = some["node"].to_numpy(), _matrix(some["vec"].combine_chunks())
    true = _first(nodes.select("node", "id", "vec").mapInArrow(_against(asked, v, k), _FOUND), "asked", k).select("asked", "node").toPandas()
    wanted = nodes.sparkSession.createDataFrame([(int(x), True) for x in asked] + [(int(x), False) for x in true["node"].unique()], "node bigint, q boolean")
    at = placed.join(F.broadcast(wanted), ["node", "q"]).toPandas()
    place = {q: part.pivot(index="node", columns="curve", values="place") for q, part in at.groupby("q")}
    return np.abs(place[True].loc[true["asked"]].to_numpy() - place[False].loc[true["node"]].to_numpy())
