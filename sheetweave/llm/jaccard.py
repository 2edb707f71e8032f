"""Near-duplicates by exact Jaccard similarity of word shingles, with SimHash links first.

Two sets whose similarity reaches a bound share an element among the first of either in any common order: of n elements
the first n - ceil(bound * n) + 1. These prefixes are the keys, so no pair is missed; pairs under a key that the sizes or
the element's places rule out go, and every pair left is verified on the whole sets. The order puts elements that many
documents of a sample share last (a common line would be a key of everything), the others by hash; it decides the work,
never the result.

What is wanted are components, so pairs that are linked already need no comparison: equal sets are one node, and before
the prefixes are compared each document is verified against others that two cheap ways propose: sets whose SimHash
fingerprints (of the same shingles) differ in two bits or fewer, found by bit-sliced comparison, and the least of those
of about its size that share its least element under a few other orders. A group of n near copies so makes about n
pairs; prefixes then only compare what is not yet linked.

Whole sets move for few pairs only. Each set carries a parity bitmap of two to four bits for each element: an element flips
its bit, so bitmaps differ in no more bits than sets differ in elements, and a pair whose bitmaps differ in too many
cannot reach the bound. Under a key of many documents the pairs are looked at where the bitmaps are, chunk by chunk: first
each document is verified against the NEAREST others that differ least by their bitmaps, then every pair that is still not
linked and that bitmaps leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm import simhash
from sheetweave.llm.components import components
from sheetweave.llm.shared import column, pieces, shelve, small_batches, text_bytes, trimmed

SHINGLE = 5
PERCENT = 80
SEED = 42
#: Orders whose least element picks the first candidates.
ORDERS = 4
#: Documents of the sample that finds common shingles, how many of them make one common, and how many are kept.
SAMPLE, COMMON, KEPT = 20_000, 8, 65_536
#: Rows under one key whose pairs are looked at at once, rows of a chunk of a larger key, and pairs of those looked at together.
SMALL, CHUNK, STEP = 32, 4_096, 1 << 20
#: Rows under a large key that each row is verified against before all others.
NEAREST = 3

_MIX = np.random.default_rng(SEED).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes (sorted) of all runs of `size` words, ASCII letters in lower case; of fewer words, of the one run there is."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w, repeat(SEED)), np.uint64, len(w))
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):  # the place of a word counts
        total = _scramble(total ^ h[i : i + len(total)])
    return np.unique(total)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)))


def _all(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(shingles(t.as_py(), size)))], ["h"])

    return run


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: 64 bits, doubled until there are two for each element."""
    m = 64
    while m < 2 * len(s):
        m *= 2
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little")


def parity_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded: elements in which the sets differ, at least."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _simhash(s: np.ndarray) -> np.uint64:
    total = np.zeros(64, np.int64)
    for lo in range(0, len(s), simhash.HELD):
        part = s[lo : lo + simhash.HELD]
        total += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    return np.packbits(total * 2 > len(s), bitorder="little").view(np.uint64)[0]


_MARKED = "row bigint, n int, digest binary, fp bigint, least array<bigint>, bits binary, prefix array<bigint>"


def _marked(size: int, percent: int, common: np.ndarray):
    """common: sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in pieces(batches):
            n, digest, fp, least, bits, prefix = [], [], [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                fp.append(_simhash(s))
                bits.append(parity(s).tobytes())
                least.append(np.array([_scramble(s * m).min() for m in _MIX[:ORDERS]], np.uint64) if len(s) else s)
                at = np.searchsorted(common, s)
                late = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                prefix.append(np.concatenate([s[~late], s[late]])[:first])
            columns = [
                b.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(_signed(np.array(fp, np.uint64))), _lists(least),
                pa.array(bits, pa.binary()), _lists(prefix)
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n", "digest", "fp", "least", "bits", "prefix"])

    return run


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs (a, b, na, nb, x, y) with sizes and bitmaps those whose bitmaps do not rule them out."""
        for b in batches:
            both = (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()).tolist()
            keep = [
                parity_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) * (100 + percent) <= n * (100 - percent)
                for x, y, n in zip(b.column(4), b.column(5), both)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


_HELD = "h bigint, i int, j int, own int, row bigint, place int, label bigint, b bigint"


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, place, row, n, label) come sorted by h. A key of up to SMALL rows gives its pairs (row, b) with
        different labels that sizes and places leave, where these are no more than the rows they join; else it gives those
        rows, and a larger one all its rows, cut into chunks: each row for every pair of chunks (i, j) that it is in, to meet
        the others there with its bitmap. So a key of up to CHUNK rows never makes more rows than it has."""
        held = None

        def group(h: int, place: np.ndarray, row: np.ndarray, n: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            if len(row) <= SMALL:
                a, b = np.nonzero((row[:, None] > row[None, :]) & _may(percent, (place, n, label), (place, n, label)))
                some = np.unique(np.concatenate([a, b]))
                if len(a) <= len(some):
                    nothing = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
                    return pa.RecordBatch.from_arrays(
                        [*nothing, pa.array(row[a]), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64()), pa.array(row[b])], _NAMES
                    )
                place, row, label = place[some], row[some], label[some]
            chunk = np.arange(len(row)) // CHUNK
            cells = [(i, j) for j in range(chunk[-1] + 1) for i in range(j + 1)]
            of = [np.flatnonzero((chunk == i) | (chunk == j)) for i, j in cells]
            at, size = np.concatenate(of), [len(x) for x in of]
            i, j = (np.repeat(np.array(x, np.int32), size) for x in zip(*cells))
            columns = [np.full(len(at), h), i, j, chunk[at].astype(np.int32), row[at], place[at].astype(np.int32), label[at]]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.int64())], _NAMES)

        def groups(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(cols[0]):
                return
            start = np.flatnonzero(np.concatenate([[True], np.diff(cols[0]) != 0]))
            end = np.append(start[1:], len(cols[0]))
            open_ = np.minimum.reduceat(cols[4], start) != np.maximum.reduceat(cols[4], start)
            for lo, hi in zip(start[open_], end[open_]):
                yield group(cols[0][lo], *[c[lo:hi] for c in cols[1:]])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy().astype(np.int64) for i in range(5)]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            yield from groups([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if held is not None:
            yield from groups(held)

    return run


_NAMES = [c.split()[0] for c in _HELD.split(", ")]


def _may(percent: int, x: tuple, y: tuple) -> np.ndarray:
    """Which of all pairs of (place, n, label) differ in label and may reach the bound, by sizes and places: elements
    before a shared one can be in common up to the smaller place, those from it on up to the smaller rest."""
    (pa_, na, la), (pb, nb, lb) = ([c[:, None] for c in x], [c[None, :] for c in y])
    shared = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    # |a and b| >= percent * |a or b| / 100, with |a or b| = na + nb - |a and b|
    return (la != lb) & (shared * (100 + percent) >= percent * (na + nb))


def _cells(percent: int, nearest: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, i, j, own, row, place, label, n, bits) come sorted by the first three; pairs of chunk i with chunk j
        that sizes, places and bitmaps leave, or of each row those with the `nearest` rows that differ least."""
        at, held = None, []

        def compare(cell: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
            own, row, place, label, n = (table.column(c).to_numpy().astype(np.int64) for c in range(3, 8))
            if label.min() == label.max():
                return
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(8)]
            words = np.fromiter(map(len, bits), np.int64, len(bits))
            for wa in np.unique(words):
                for wb in np.unique(words):
                    left, right = (np.flatnonzero((own == c) & (words == w)) for c, w in ((cell[1], wa), (cell[2], wb)))
                    # A bitmap has two to four bits for each element, so sizes within the bound give less than twice its ratio.
                    if not len(left) or not len(right) or max(wa, wb) * percent >= 200 * min(wa, wb):
                        continue
                    w = min(wa, wb)
                    x, y = (np.bitwise_xor.reduce(np.stack([bits[i] for i in of]).reshape(len(of), -1, w), axis=1) for of in (left, right))
                    step = max(1, STEP // (len(right) * int(w)))
                    for lo in range(0, len(left), step):
                        some = left[lo : lo + step]
                        ok = _may(percent, (place[some], n[some], label[some]), (place[right], n[right], label[right]))
                        ok &= row[some][:, None] > row[right][None, :] if cell[1] == cell[2] else row[some][:, None] != row[right][None, :]
                        a, b = np.nonzero(ok)
                        differ = np.bitwise_count(x[lo + a] ^ y[b]).sum(axis=1, dtype=np.int64)
                        both = n[some[a]] + n[right[b]]
                        keep = np.flatnonzero(differ * (100 + percent) <= both * (100 - percent))
                        if nearest is not None and len(keep):
                            keep = keep[np.lexsort((differ[keep] / both[keep], a[keep]))]
                            start = np.flatnonzero(np.diff(a[keep], prepend=-1))
                            keep = keep[np.arange(len(keep)) - np.repeat(start, np.diff(start, append=len(keep))) < nearest]
                        if len(keep):
                            yield pa.RecordBatch.from_arrays([pa.array(row[some[a[keep]]]), pa.array(row[right[b[keep]]])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)])
            starts = np.flatnonzero((np.diff(key, axis=1, prepend=key[:, :1] - 1) != 0).any(axis=0))
            for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
                if at is not None and at != tuple(key[:, lo]):
                    yield from compare(at, pa.Table.from_batches(held).combine_chunks())
                    held = []
                at = tuple(key[:, lo])
                held.append(b.slice(lo, hi - lo))
        if at is not None:
            yield from compare(at, pa.Table.from_batches(held).combine_chunks())

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], ["row", "set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])

    return run


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs (a, b, na, nb, x, y) that sizes and bitmaps leave."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.where((F.col("a") != F.col("b")) & sizes).select("a", "b", "na", "nb", "x", "y").mapInArrow(trimmed(_possible(percent)), "a bigint, b bigint")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (src, dst) among pairs (a, b) whose whole sets reach the bound. texts: (row, text: binary)."""
    pairs = shelve(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # Written, so that Spark knows its size and only moves the texts if it is too large to be sent to them.
    wanted = shelve(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct())
    with small_batches(texts.sparkSession):
        sets = shelve(texts.join(wanted, "row", "left_semi").mapInArrow(trimmed(_sets(size)), "row bigint, set binary"))
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    with small_batches(texts.sparkSession):
        return shelve(both.select("a", "b", "x", "y").mapInArrow(trimmed(_verify(percent)), "src bigint, dst bigint"))


def _proposed(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, x, y) that SimHash links and shared least elements propose, about one for each node and way.
    nodes: (row, n, fp, least, bits), without empty sets."""
    star = F.min(F.struct("row", "n", "bits")).alias("c")
    pair = [
        F.col("row").alias("a"), F.col("c.row").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"), F.col("bits").alias("x"),
        F.col("c.bits").alias("y")
    ]
    about = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    keyed = nodes.select("row", "n", "bits", about.alias("about"), F.posexplode("least").alias("k", "h"))
    keys = ["k", "h", "about"]
    shared = keyed.join(keyed.groupBy(*keys).agg(star, F.count("*").alias("m")).where("m > 1"), keys).select(*pair)
    by_fp = shelve(nodes.groupBy("fp").agg(star))
    same = nodes.join(by_fp, "fp").select(*pair)
    found = simhash.links(by_fp.select("fp"))
    ends = by_fp.select(F.col("fp").alias("dst"), "c")
    near = found.join(
        by_fp.select(F.col("fp").alias("src"), F.col("c.row").alias("row"), F.col("c.n").alias("n"), F.col("c.bits").alias("bits")), "src"
    ).join(ends, "dst").select(*pair)
    return reduce(DataFrame.unionByName, (shared, same, near))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) for each row of docs, whose ids are distinct whole numbers without nulls.

    component_id is the least id reachable through texts whose sets of `shingle`-word runs have a Jaccard similarity of
    at least `percent` / 100, the document's own included. Texts without words (empty, null) are one component; texts of
    any length are compared whole. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(column(docs, id_col).cast("long").alias("row"), text_bytes(column(docs, text_col)).alias("text"))
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(trimmed(_all(shingle)), "h bigint")
    often = sample.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= COMMON).orderBy(F.desc("k"), "h").limit(KEPT).select("h")
    common = np.sort(often.toArrow()["h"].to_numpy().view(np.uint64))  # KEPT at most
    with small_batches(docs.sparkSession):
        marked = shelve(texts.mapInArrow(trimmed(_marked(shingle, percent, common)), _MARKED))
    equal = shelve(marked.groupBy("digest").agg(F.min("row").alias("dst")))
    copies = marked.select("row", "digest").join(equal, "digest").where("row <> dst").select(F.col("row").alias("src"), "dst")
    one = equal.select(F.col("dst").alias("row"))
    nodes = shelve(marked.where("n > 0").select("row", "n", "fp", "least", "bits").join(one, "row", "left_semi"))
    first = shelve(components(_linked(_candidates(_proposed(nodes, percent), percent), texts, shingle, percent)))
    known = marked.where("n > 0").select("row", "n", "prefix").join(one, "row", "left_semi").join(first.withColumnRenamed("node", "row"), "row", "left")
    rows = known.select(
        F.posexplode("prefix").alias("place", "h"), "row", "n", F.coalesce("root", "row").alias("label")
    ).select("h", "place", "row", "n", "label")
    held = shelve(rows.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(_pairs(percent)), _HELD))
    pairs = held.where("h IS NULL").select(F.col("row").alias("a"), "b").distinct()
    bits = [nodes.select(F.col("row").alias(r), F.col("n").alias(f"n{r}"), F.col("bits").alias(x)) for r, x in (("a", "x"), ("b", "y"))]
    few = _candidates(pairs.join(bits[0], "a").join(bits[1], "b"), percent)
    columns = ["h", "i", "j", "own", "row", "place", "label", "n", "bits"]
    cells = shelve(held.where("h IS NOT NULL").join(nodes.select("row", "n", "bits"), "row").select(*columns))

    def met(cells: DataFrame, nearest: int | None) -> DataFrame:
        ordered = cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        return ordered.mapInArrow(trimmed(_cells(percent, nearest)), "a bigint, b bigint")

    # A node's own label stands for the edges of the round before.
    labels = lambda df: df.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    close = _linked(few.unionByName(met(cells, NEAREST)), texts, shingle, percent)
    second = shelve(components(close.unionByName(labels(first))))
    apart = cells.drop("label").join(second.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("root", "row")).select(*columns)
    rest = _linked(met(apart, None), texts, shingle, percent)
    # A copy's edge leads to its node.
    roots = components(rest.unionByName(labels(second)).unionByName(copies))
    return texts.select("row").join(roots, F.col("row") == F.col("node"), "left").select(
        F.col("row").alias("doc_id"), F.coalesce("root", "row").alias("component_id")
    )
