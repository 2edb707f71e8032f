"""Substring dedup: words in a window that an earlier document has too are removed, found by FM-indexes over shards.

Windows of a document are dealt to shards by their anchor, the least hash of the short runs of words in them; equal
windows have equal anchors, so whatever can match meets in one shard, and a stretch of windows with one anchor travels
as one row. Stretches whose anchor only one document has are left out before their words are sent.

A shard's distinct stretches are indexed in blocks: suffixes sorted as deep as a window, their Burrows-Wheeler transform
in a wavelet matrix of packed bit planes with counts. The stretches then stream backwards through the index, all of a
block at once, one word a step: the interval of suffixes that begin with what was read shrinks, and once it is a window
deep it is widened to that of the window again, so the matching statistics (bounded by the window) cost one step a word.
An interval a window deep gives the least document that has the window. Intervals of windows with a document before
their own are reported and their words go.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, give_back, remove, scope, shelve_at, text_bytes, trimmed

WINDOW = 13
#: Words of a run whose hash can be an anchor.
GRAM = 3
#: Windows that one row holds at most.
STRETCH = 256
#: Words that a block of the index holds, but for a last anchor's rest.
BLOCK = 1 << 18
#: Texts whose words are hashed together.
TEXTS = 500
#: Documents of the sample that finds frequent anchors, how many of them make one frequent, and how many are kept.
SAMPLE, COMMON, KEPT = 20_000, 16, 8_192
_NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """A keyed 64-bit hash (SipHash) of each word, uint64."""
    import pandas as pd

    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def _runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` codes."""
    total = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for i in range(size):
        total = _scramble(total * _MIX + codes[i : i + len(total)])
    return total


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` neighbours: minima of doubled reach, the last overlapping."""
    reach = 1
    while 2 * reach <= size:
        x, reach = np.minimum(x[: len(x) - reach], x[reach:]), 2 * reach
    rest = size - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(codes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, fingerprint) of every stretch of some documents' words, one document after the other."""
    none = np.empty(0, np.int64)
    if len(codes) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = min(GRAM, window)
    anchor = _sliding_least(_runs(codes, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    start = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :])
    anchor, doc = anchor[start], doc[start]
    at = start - begin[doc]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    new |= (np.arange(len(start)) - run[np.cumsum(new) - 1]) % STRETCH == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    return doc[first], at[first], n, anchor[first], _fingerprints(codes, start[first], n + window - 1)


def _fingerprints(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of `size` codes from each place on: differences of running sums of codes times powers, taken back to the first power."""
    power = np.full(len(codes) + 1, _MIX, np.uint64)
    back = np.full(len(codes) + 1, pow(int(_MIX), -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_scramble(codes) * power[:-1], out=total[1:])
    return _scramble((total[at + size] - total[at]) * back[at] + size.astype(np.uint64))


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = [t.as_py().split() for t in texts]
    return word_codes([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_SPANS = "a bigint, f bigint, d bigint, h bigint, at int, n int, one boolean"


def _anchored(window: int):
    """Batches (d, h, text) -> stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                doc, at, n, anchor, f = stretches(*_coded(part.column(2)), window)
                d, h = (pa.array(part.column(i).to_numpy()[doc]) for i in (0, 1))
                columns = [_signed(anchor), _signed(f), d, h, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(at), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "f", "d", "h", "at", "n", "one"])

    return trimmed(run)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by (a, f, d, h, at) those whose anchor two documents have, without repeats. The first of equal
    ones, that of the least document, is marked as `one`. What waits between batches is of one anchor and one document."""
    held: pa.RecordBatch | None = None
    last = None  # (a, f, d, h, at) of the last row handed on, and the first document of its anchor
    shared = None  # the anchor that the last batch ended with, if it is known to be shared
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.concat_batches([held, b])
        a, f, d, h, at = (b.column(i).to_numpy() for i in range(5))
        edge = np.append(True, a[1:] != a[:-1])
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(a))
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        several[0] |= shared is not None and a[0] == shared
        one = edge | np.append(True, f[1:] != f[:-1])
        new = one | np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1]))
        if last is not None and last[0] == a[0] and last[1] == f[0]:
            one[0] = False
            new[0] = last[2:] != (d[0], h[0], at[0])
        keep = np.repeat(several, end - start) & new
        shared = a[-1] if several[-1] else None
        held = None if several[-1] else b.slice(start[-1])
        last = (a[-1], f[-1], d[-1], h[-1], at[-1]) if several[-1] else None
        yield b.set_column(6, "one", pa.array(one)).filter(pa.array(keep))


_WORDS = "a bigint, f bigint, d bigint, h bigint, at int, least bigint, words binary"


def _worded(window: int, varied: np.ndarray):
    """Batches (d, h, text, spans) -> stretches, the marked ones with their words. Of stretches of frequent anchors, which no
    one has marked, the first of equal ones among some texts has them, and the least document of these. Those of varied
    anchors come window by window, each under its own hash, so that only equal windows share a key. varied: sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                codes, sizes = _coded(part.column(2))
                begin = np.cumsum(sizes) - sizes
                spans = part.column(3)
                d, h = (part.column(i).to_numpy() for i in (0, 1))
                again = np.append(before == (d[0], h[0]), (d[1:] == d[:-1]) & (h[1:] == h[:-1]))  # repeated rows, side by side
                before = (d[-1], h[-1])
                doc = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
                flat = spans.flatten()
                at, n, a, f = (flat.field(i).to_numpy().astype(np.int64) for i in range(4))
                one = flat.field(4)
                free, one = one.is_null().to_numpy(zero_copy_only=False), one.fill_null(False).to_numpy(zero_copy_only=False)
                alone = np.isin(a, varied) & free
                times = np.where(alone, n, 1) * ~again[doc]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                doc, at, n, a, f, free, one, alone = (np.repeat(x, times) for x in (doc, at, n, a, f, free, one, alone))
                at, n = at + nth, np.where(alone, 1, n)
                a[alone], f[alone] = _runs_at(codes, begin[doc[alone]] + at[alone], window).view(np.int64), 0
                least = d[doc]
                order = np.flatnonzero(free)
                order = order[np.lexsort((least[order], f[order], a[order]))]
                first = np.append(True, (a[order][1:] != a[order][:-1]) | (f[order][1:] != f[order][:-1]))[: len(order)]
                one[order] = first
                body, lo_ = codes.tobytes(), 8 * (begin[doc] + at)
                words = [body[p : p + k] if o else None for o, p, k in zip(one.tolist(), lo_.tolist(), (8 * (n + window - 1)).tolist())]
                columns = [*map(pa.array, (a, f, d[doc], h[doc], at.astype(np.int32), least)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "f", "d", "h", "at", "least", "words"])

    return trimmed(run)


def _runs_at(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(at), size, np.uint64)
    for i in range(size):
        total = _scramble(total * _MIX + codes[at + i])
    return total


class Wavelets:
    """A sequence of small numbers in bit planes of a wavelet matrix: 64 bits a machine word and a count for each word."""

    def __init__(self, x: np.ndarray):
        self.planes, n = [], len(x)
        top = int(x.max(initial=0))
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (x >> bit & 1).astype(bool)
            packed = np.zeros(-(-(n + 1) // 64) * 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(ones, bitorder="little")
            packed = packed.view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = n - int(counts[-1])
            self.planes.append((bit, packed, counts, zeros))
            x = np.concatenate([x[~ones], x[ones]])
        every = np.arange(top + 1)
        self.begin = self._down(every, np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.planes:
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & below)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, i) - self.begin[symbol]


class Index:
    """FM-index over stretches of word codes. document: of each stretch, whose least a window is answered with."""

    def __init__(self, parts: list[np.ndarray], document: np.ndarray, window: int):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.window, self.sizes = window, sizes
        self.last = np.cumsum(sizes + 1) - 2  # of each stretch; a separator (0) follows it
        own = np.ones(int((sizes + 1).sum()), bool)
        own[self.last + 1] = False
        self.text = np.zeros(len(own), np.int64)
        self.text[own] = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
        n, reach, ranks = len(own), 1, {1: self.text}
        while reach <= window:  # beyond a window by one word, as intervals are widened after a step
            rank = ranks[reach]
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            ranks[2 * reach] = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
            reach *= 2
        order = np.argsort(ranks[reach], kind="stable")
        half = max(r for r in ranks if r <= window)  # a window is two overlapping halves
        pair = np.zeros(n, np.int64)
        pair[: n - (window - half)] = ranks[half][window - half :] + 1
        deep = ranks[half][order] * (n + 2) + pair[order]
        start = np.flatnonzero(np.append(True, deep[1:] != deep[:-1]))
        size = np.diff(np.append(start, n))
        self.low, self.high = np.repeat(start, size), np.repeat(start + size, size)
        of = np.repeat(document, sizes + 1)
        self.least = np.repeat(np.minimum.reduceat(of[order], start), size)
        self.waves = Wavelets(self.text[order - 1])
        self.before = np.cumsum(np.bincount(self.text)) - np.bincount(self.text)

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Every stretch read backwards, all in step: (stretch, least document) of each window, a stretch's last window first."""
        active = np.arange(len(self.sizes))
        low, high = np.zeros(len(active), np.int64), np.full(len(active), len(self.text))
        found = []
        for depth in range(1, int(self.sizes.max(initial=0)) + 1):
            on = self.sizes[active] >= depth
            active, low, high = active[on], low[on], high[on]
            word = self.text[self.last[active] - depth + 1]
            both = self.waves.rank(np.concatenate([word, word]), np.concatenate([low, high])) + np.tile(self.before[word], 2)
            low, high = np.split(both, 2)
            if depth >= self.window:
                low, high = self.low[low], self.high[low]
                found.append((active, self.least[low]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_FOUND = "a bigint, f bigint, least array<bigint>"


def _searched(window: int):
    """Batches (a, f, d, words) sorted by (a, f) -> for each stretch the least document of each of its windows."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        a, f, d = (rows.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])))
        d = np.minimum.reduceat(d, first)
        words = rows.column(3).take(pa.array(first))
        index = Index([np.frombuffer(w.as_buffer(), np.uint64) for w in words], d, window)
        stretch, least = index.search()
        least = least[np.argsort(stretch, kind="stable")]
        n = index.sizes - window + 1
        end = np.cumsum(n)
        # A stretch's windows were found from its last to its first.
        back = np.repeat(end - 1, n) - (np.arange(end[-1]) - np.repeat(end - n, n))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(least[back]))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(f[first]), lists], ["a", "f", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(3).nbytes // 8
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            a = rows.column(0).to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield block(rows.slice(0, cut))
                held = pa.table(rows.slice(cut)).to_batches()
                size = sum(x.column(3).nbytes // 8 for x in held)
        if held:
            yield block(pa.Table.from_batches(held).combine_chunks())

    return trimmed(run)


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of steps that are written are deleted once the JVM finds their plans unused, which it is asked to do now:
    Python lets go of its handles first, and Spark's cleaner works on its own threads, hence the short waits."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()
    time.sleep(0.5)


def _frequent(keyed: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that COMMON documents or more of a bounded sample have, KEPT at most, sorted; and those of them with as many different stretches."""
    every = max(1, keyed.count() // SAMPLE)
    some = keyed.where(F.pmod(F.xxhash64("d", "h"), F.lit(every)) == 0).mapInArrow(_anchored(window), _SPANS)
    counts = some.groupBy("a").agg(F.count_distinct("d", "h").alias("k"), F.count_distinct("f").alias("v")).where(F.col("k") >= COMMON)
    often = counts.orderBy(F.desc("k"), "a").limit(KEPT).toArrow().sort_by("a")
    a, v = (often[c].to_numpy().astype(np.int64) for c in ("a", "v"))
    return a, a[v >= COMMON]


def repeats(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, starts): where in each document windows begin that a document of smaller d has too. keyed: (d, h, text as bytes).

    The result is written to the shared folder; steps towards it are written there and deleted."""
    spark = keyed.sparkSession
    frequent, varied = _frequent(keyed, window)
    with scope(spark) as wanted:
        spans = keyed.mapInArrow(_anchored(window), _SPANS)
        known = F.broadcast(spark.createDataFrame(pa.table({"a": pa.array(frequent)})))  # KEPT rows at most
        found = spans.join(known, "a", "left_anti").repartition("a").sortWithinPartitions("a", "f", "d", "h", "at").mapInArrow(trimmed(_shared), _SPANS)
        if len(frequent):  # that several documents have these is known
            found = found.unionByName(spans.join(known, "a", "left_semi"))
        of, of_at = shelve_at(found.groupBy("d", "h").agg(F.collect_set(F.struct("at", "n", "a", "f", "one")).alias("spans")))
        del spans, found
        _let_go(spark)
        met = keyed.join(of, ["d", "h"]).select("d", "h", "text", "spans")
        worded, _ = shelve_at(met.mapInArrow(_worded(window, varied), _WORDS))
        del of, met
        remove(spark, of_at)
        _let_go(spark)
        distinct = worded.where("words IS NOT NULL").select("a", "f", F.col("least").alias("d"), "words")
        least, _ = shelve_at(distinct.repartition("a").sortWithinPartitions("a", "f").mapInArrow(_searched(window), _FOUND))
        del distinct
        _let_go(spark)
        own = worded.select("a", "f", "d", "h", "at").join(least.withColumnRenamed("least", "first"), ["a", "f"])
        starts = F.filter(F.transform("first", lambda m, i: F.when(m < F.col("d"), F.col("at") + i)), lambda x: x.isNotNull())
        own = own.select("d", "h", starts.alias("starts")).where(F.size("starts") > 0)
        out, path = shelve_at(own.groupBy("d", "h").agg(F.flatten(F.collect_list("starts")).alias("starts")))
        wanted.append(path)
    del worded, least, own
    _let_go(spark)
    return out


_OUT = "n_words bigint, n_removed bigint, kept string"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out: str = "substrings") -> tuple[DataFrame, str]:
    """docs with one more column (struct: n_words, n_removed, kept), named `out` or a longer name if docs has that.

    A word goes if a window of `window` words around it also starts in a document with a smaller id; windows are judged on
    the input. kept joins what stays by single spaces. A null text has no words and stays empty; a null id counts as
    larger than any; rows of equal id take nothing from each other, and equal rows fare alike; texts shorter than a window
    lose nothing; texts of any length are read whole; other columns stay whatever their names; an empty table stays empty.
    Words are compared by 64-bit keyed hashes, a window of them in a row. Stretches of anchors that many documents have (COMMON
    of a sample of SAMPLE) are made one row for each different stretch of a task's texts, and windows alone where stretches
    differ; so the rows of a key are those of about COMMON in SAMPLE documents at most.
    """
    mark = {c: free_name(docs, c) for c in ("d_", "h_")}
    text = text_bytes(column(docs, text_col))
    key = {mark["d_"]: F.coalesce(column(docs, id_col).cast("long"), F.lit(_NO_ID)), mark["h_"]: F.xxhash64(text)}
    keyed = docs.select(key[mark["d_"]].alias("d"), key[mark["h_"]].alias("h"), text.alias("text"))
    found = repeats(keyed, window).select(F.col("d").alias(mark["d_"]), F.col("h").alias(mark["h_"]), F.col("starts").alias(name := free_name(docs, out)))

    @F.arrow_udf(_OUT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts in batches:
            for lo in range(0, len(texts), TEXTS):
                n, gone, kept = [], [], []
                for t, at in zip(texts[lo : lo + TEXTS], starts[lo : lo + TEXTS]):
                    words = t.as_py().split()
                    n.append(len(words))
                    if at.is_valid:
                        edge = np.zeros(len(words) + 1, np.int64)
                        first = at.values.to_numpy()
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + window, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        words = [w for w, s in zip(words, stays.tolist()) if s]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                kept = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept], ["n_words", "n_removed", "kept"])
        give_back()

    joined = docs.withColumns(key).join(found, list(mark.values()), "left")
    return joined.withColumn(name, cut(text, F.col(name))).drop(*mark.values()), name


#: The contract's rows in DuckDB.
SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM cut
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM starts
), early AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) <> max(doc_id)
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN early USING (k) WHERE first < doc_id
), gone AS (
  SELECT doc_id, list(i) AS removed FROM covered GROUP BY doc_id
)
SELECT c.doc_id, len(w)::BIGINT AS n_words, coalesce(len(removed), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN removed IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(removed, i)) END, ' '), '')) AS kept_sha256
FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id
"""
