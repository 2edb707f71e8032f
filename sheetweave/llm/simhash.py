"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints are keyed so that any two within RADIUS bits share a key: the bits are cut into four parts, and
two differing bits leave at least two parts alike, so each pair of parts is a key. A key held by more than HOT
fingerprints is cut again within the bits it leaves open (twice at most: then 8 open bits are left), so no task ever
compares an unbounded group and none is dropped.

Fingerprints with a common key are compared bit-sliced: plane b holds bit b of all members of a block, one bit each;
a query's distances to 64 members at a time are counted by carry-save adders over the planes, and the block is
abandoned as soon as every distance is above the radius. Members of a block that are linked leave as a star around the
least, so a group of n near copies makes n - 1 edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.components import components
from sheetweave.llm.shared import column, free_name, pieces, scope, shelve, shelve_at, text_bytes

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints under one key that one task compares at once.
HOT = 4096
#: Rows of several small keys that share a block.
BLOCK = 512
#: Shingle hashes of one text that are held at a time.
HELD = 65_536


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one UTF-8 text: bit set where over half of the shingles' hashes have it; no words: 0."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    total, n = np.zeros(64, np.int64), len(w) - SHINGLE + 1
    for lo in range(0, n, HELD):
        part = w[lo : lo + HELD + SHINGLE - 1]
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(part, part[1:], part[2:])), repeat(SEED)), np.uint64)
        total += np.add.reduce(np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pieces(texts):
        yield pa.array(np.array([fingerprint(x.as_py()) for x in batch], dtype=np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> tuple[DataFrame, str]:
    """docs with the SimHash as a signed 64-bit column named `out`, or a longer name if docs has that; null texts have no words."""
    name = free_name(docs, out)
    return docs.withColumn(name, F.arrow_udf(_fingerprints, "bigint")(text_bytes(column(docs, text_col)))), name


def _parts(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The keys within some bits: every pair of their four parts."""
    n = len(bits) // 4
    cut = [bits[i * n : (i + 1) * n] for i in range(4)]
    return [a + b for a, b in combinations(cut, 2)]


def _masks(level: int) -> list[int]:
    """Bits that the keys of a level hold fixed; the 6 keys within key k of a level are the next level's 6k to 6k + 5."""
    masks = [0]
    for _ in range(level + 1):
        masks = [m | sum(1 << b for b in part) for m in masks for part in _parts(tuple(b for b in range(64) if not m >> b & 1))]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """(fp, k, value): each fingerprint under its keys of a level. rows: (fp) or, from level 1 on, (fp, k of the level above)."""
    masks = [_signed(m) for m in _masks(level)]
    if level:
        group = F.element_at(F.array(*[F.array(*[F.lit(m) for m in masks[i : i + 6]]) for i in range(0, len(masks), 6)]), F.col("k") + 1)
        first = F.col("k") * 6
    else:
        group, first = F.array(*[F.lit(m) for m in masks]), F.lit(0)
    out = rows.select("fp", first.alias("first"), F.posexplode(group).alias("i", "mask"))
    return out.select("fp", (F.col("first") + F.col("i")).alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def near(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit-sliced comparison of all of fps (uint64) with each other: row i, bit j (little) is set if i and j are near."""
    assert radius == 2, "the counters below saturate above two"
    n = len(fps)
    width = -(-n // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(n, 64).T
    open_ = np.flatnonzero(bits[:, :n].min(axis=1) != bits[:, :n].max(axis=1))  # planes in which members differ at all
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    all_ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((n, width), np.uint64)
    step = max(1, 65_536 // width)
    for lo in range(0, n, step):
        own = np.where(bits[:, lo : min(n, lo + step)].astype(bool), all_ones, np.uint64(0))
        rows = np.arange(own.shape[1])
        ones, twos, far = (np.zeros((len(rows), width), np.uint64) for _ in range(3))
        result = np.zeros((len(rows), width), np.uint64)
        for i, b in enumerate(open_):
            x = planes[b][None, :] ^ own[b, rows][:, None]
            carry = ones & x
            ones ^= x
            far |= twos & carry  # a fourth difference
            twos ^= carry
            if i % 8 == 7 or i == len(open_) - 1:
                far |= ones & twos  # a third
                live = ~(far == all_ones).all(axis=1)
                if not live.all():  # abandoned: nothing in the block is near these
                    rows, ones, twos, far = rows[live], ones[live], twos[live], far[live]
                    if not len(rows):
                        break
        if len(rows):
            result[rows] = ~far
        out[lo : lo + own.shape[1]] = result
    return out


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, least fp linked to it through members of the block), without those that are the least themselves."""
    n = len(fps)
    linked = near(fps)
    root = np.full(n, -1, np.int64)
    degree = np.bitwise_count(linked).sum(axis=1)
    for i in np.argsort(fps.view(np.int64), kind="stable"):
        if root[i] >= 0:
            continue
        root[i] = i
        edge = [i] if degree[i] > 1 else []
        while edge:
            row = np.bitwise_or.reduce(linked[edge], axis=0)
            hit = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little", count=n))
            edge = hit[root[hit] < 0]
            root[edge] = i
            edge = edge.tolist()
    tied = np.flatnonzero(root != np.arange(n))
    return fps[tied].view(np.int64), fps[root[tied]].view(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, value, fp) come sorted; whole keys are gathered into blocks of at least BLOCK rows."""
    held_k, held_v, held_f = (np.empty(0, t) for t in (np.int32, np.int64, np.int64))

    def block(f: np.ndarray) -> pa.RecordBatch:
        src, dst = stars(np.unique(f).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    for b in batches:
        held_k, held_v, held_f = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate((held_k, held_v, held_f)))
        starts = np.flatnonzero((np.diff(held_k) != 0) | (np.diff(held_v) != 0)) + 1  # of keys; the last may go on in the next batch
        lo = 0
        for s in starts:
            if s - lo >= BLOCK:
                yield block(held_f[lo:s])
                lo = s
        held_k, held_v, held_f = held_k[lo:], held_v[lo:], held_f[lo:]
    if len(held_f) > 1:
        yield block(held_f)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst) edges that connect exactly the fingerprints (column fp, distinct) within RADIUS bits of each other."""
    found = None
    rows = fps
    for level in range(3):
        keyed = _keyed(rows, level)
        counts = keyed.groupBy("k", "value").agg(F.count("*").alias("n"))
        some = counts.where((F.col("n") > 1) & (F.col("n") <= hot)) if level < 2 else counts.where("n > 1")
        inside = keyed.join(some.select("k", "value"), ["k", "value"], "left_semi")
        inside = inside.repartition("k", "value").sortWithinPartitions("k", "value", "fp").select("k", "value", "fp")
        edges = inside.mapInArrow(_compare, "src bigint, dst bigint")
        found = edges if found is None else found.unionByName(edges)
        if level == 2:
            break
        many = counts.where(F.col("n") > hot).select("k", "value")
        if level == 0:
            many = shelve(many)
            if many.isEmpty():
                break
        rows = shelve(keyed.join(many, ["k", "value"], "left_semi").select("fp", "k"))
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs.

    component_id is the least id reachable through fingerprints that differ in RADIUS bits or fewer, the document's own
    included; texts without words (empty, null) share fingerprint 0 and are linked like any other. A null id takes no
    part in the least; a component without any id has a null one. Repeated rows come out repeated. Texts of any length
    are read whole. Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    body = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    marked, fp = fingerprints(body, "text", "fp")
    marked = shelve(marked.select("doc_id", F.col(fp).alias("fp")))
    distinct = shelve(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    tied = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("of"), "component_id")
    out = marked.join(named, F.col("fp") == F.col("of"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: Callable[[DataFrame, str, str], DataFrame] = dedup) -> DataFrame:
    """One row of each component of dedup(), with all its columns: that of least id (a null id last), then of least row number.

    `group` names the components instead of dedup(): from rows, an id and a text column to (doc_id, component_id).

    Only ids, fingerprints and a number for each row are shuffled to choose; the rows that go are then looked up by that
    number, so texts move at most once, and not at all where the list of those rows is small enough for Spark to send it
    to them. Equal rows are told apart by the number too, so one of them stays.
    """
    row, of = free_name(docs, "row"), free_name(docs, "of")
    spark = docs.sparkSession
    with scope(spark) as stays:
        # The number must be the same in both reads, so it is fixed in the written copy.
        held, at = shelve_at(docs.withColumn(row, F.monotonically_increasing_id()))
        roots = group(
            held.select(F.col(row).alias("row"), column(held, text_col).alias("text")), "row", "text"
        ).select(F.col("doc_id").alias("row"), "component_id")
        keys = held.select(F.col(row).alias("r"), column(held, id_col).alias("id"))
        named = shelve(roots.join(keys, F.col("row") == F.col("r")).select("row", "component_id", "id"))
        best = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")
        several = named.groupBy("component_id").agg(best, F.count("*").alias("n")).where("n > 1").select(F.col("component_id").alias("c"), F.col("best.row").alias("stays"))
        same = F.col("component_id").eqNullSafe(F.col("c"))
        gone, of_gone = shelve_at(named.join(several, same).where("row <> stays").select(F.col("row").alias(of)))
        stays += [at, of_gone]
    return held.join(gone, F.col(row) == F.col(of), "left_anti").drop(row)
