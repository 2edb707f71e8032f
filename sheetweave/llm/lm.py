"""Language-model scores by stupid backoff (Brants et al., 2007), with relational count tables.

Words and neighbouring pairs are counted over the whole corpus. S(w | v) = c(v w) / c(v) if other documents hold the
pair (the document's own occurrences are taken off c(v w), so a text does not vouch for itself), else 0.4 c(w) / N; c(v)
counts v with a successor. The first word is scored as one backed off. A document's score is the mean of the natural
logarithms over its words. The order is two: a third order would double the rows that are shuffled.

Words are numbers: the HEAD most frequent their rank, all others 62 bits of their hash. Which words are frequent is read
from a bounded sample of documents; it decides where a count is kept, never what it is.

How the tables meet. One pass counts words, and pairs of the CORE most frequent words, over all texts. The counts of
ranked words and core pairs have a fixed size and are looked up; the table of the other words stays distributed. A
second pass explodes each document into its pairs, which leave it once, with their number in it, partitioned by hash:
pairs of ranked words by the pair, a pair with an unranked word by that word, where it meets the word's row of the count
table. A pair of two unranked words goes to both: one adds the pair's or the word's count, the other the context's. So
counts are joined where the pairs are counted, and what a partition knows of a document leaves as one sum.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sheetweave.llm.shared import column, shelve, steady, text_bytes

BACKOFF = 0.4
HEAD = 1 << 16
#: A pair outside this square is a key with at most 1 / CORE of all rows, as its rarer word has no larger share.
CORE = 1_024
#: Documents (on average) of the sample that ranks words.
SAMPLE = 20_000
#: Rows that one step of the joined counts works on; a pair's rows are held together.
STEP = 150_000
#: Unranked words that a counting task adds up before it passes them on.
ADDED = 1_000_000
#: Texts, and bytes of them, that are worked on at once.
GROUP, PIECE = 64, 1 << 18
_LOW = (1 << 24) - 1


@dataclass(frozen=True)
class Head:
    """Ranked words: code, count, count as context; total: all words; core: counts of pairs by rank."""

    codes: np.ndarray = field(repr=False, default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(repr=False, default_factory=lambda: np.empty(0, np.int64))
    contexts: np.ndarray = field(repr=False, default_factory=lambda: np.empty(0, np.int64))
    total: int = 0
    core: np.ndarray | None = field(repr=False, default=None)
    size: int = HEAD
    core_size: int = CORE


#: A number for each byte, the same for capital and small ASCII letters, and the base of the polynomial over a word's bytes.
_OF_BYTE = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_OF_BYTE[ord("A") : ord("Z") + 1] = _OF_BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i < n."""
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], from running sums over the bytes of PIECE or, if one is longer, one word."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        n = int(ends[j - 1]) - lo
        power, inverse = _powers(max(PIECE, 1 << n.bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_OF_BYTE[data[lo : lo + n]] * power[:n])])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * inverse[s]
        i = j
    return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Coder:
    """Texts as word codes: the rank of a ranked word, else 62 bits of the hash, negative and even."""

    def __init__(self, head: Head):
        self.bits = max(10, (8 * len(head.codes)).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        rank, at = np.arange(len(head.codes), dtype=np.int32), self._slot(head.codes)
        while len(rank):  # open addressing: of those that want a free slot one gets it, the others look further
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]], self.ranks[at[free]] = head.codes[rank[free]], rank[free]
            rest = self.ranks[at] != rank
            rest |= self.keys[at] != head.codes[rank]
            rank, at = rank[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return codes >> 1 & (1 << self.bits) - 1

    def _ranked(self, codes: np.ndarray) -> np.ndarray:
        at, open_ = self._slot(codes), np.arange(len(codes))
        out = codes.copy()
        while len(open_):
            key = self.keys[at]
            hit = key == codes[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (key != 0)
            at, open_ = (at[on] + 1) & (len(self.keys) - 1), open_[on]
        return out

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first, words of each, codes of all words) for GROUP texts (binary, no nulls) at a time.

        Words are those between ASCII white space, with A-Z lowered."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for lo in range(0, len(texts), GROUP):
            at = offsets[lo : min(len(texts), lo + GROUP) + 1]
            data, at = every[at[0] : at[-1]], at - at[0]
            word = ~_SPACE[data]
            edge = np.ones(len(data) + 1, bool)  # before a byte: white space or the start of a text
            edge[1:] = ~np.append(word, False)[:-1] if len(word) else True
            edge[at] = True
            starts = np.flatnonzero(word & edge[:-1])
            after = np.append(~word[1:], True) if len(word) else word
            after[at[1:][at[1:] > 0] - 1] = True
            ends = np.flatnonzero(word & after) + 1
            codes = ((hashes(data, starts, ends) | np.uint64(1 << 63)) & np.uint64(2**64 - 2)).view(np.int64)
            yield lo, np.diff(np.searchsorted(starts, at)), self._ranked(codes)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, count, count) added up by key."""
    key, *counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1)) if len(key) else np.empty(0, np.int64)
    return key[order][start], *(np.add.reduceat(c[order], start) if len(key) else c for c in counts)


def _counted(head: Head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(code, c, cc) of words; core pairs follow the ranks, as head.size + v * core_size + w."""
        coder, h, n = Coder(head), len(head.codes), head.core_size
        ranked, context, core = np.zeros(h + 1, np.int64), np.zeros(h + 1, np.int64), np.zeros(n * n, np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def row(code: np.ndarray, c: np.ndarray, cc: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(c), pa.array(cc)], ["code", "c", "cc"])

        for b in batches:
            for _, sizes, code in coder.groups(b.column(0)):
                inner = np.ones(len(code), bool)
                inner[(np.cumsum(sizes) - 1)[sizes > 0]] = False  # all but last words
                at = np.where(code >= 0, code, h)
                ranked += np.bincount(at, minlength=h + 1)
                context += np.bincount(at[inner], minlength=h + 1)
                if h:
                    both = inner[:-1] & (at[:-1] < min(n, h)) & (at[1:] < min(n, h))
                    pair, times = np.unique(at[:-1][both] * n + at[1:][both], return_counts=True)
                    core[pair] += times
                rare = code < 0
                word, place, c = np.unique(code[rare], return_inverse=True, return_counts=True)
                held.append((word, c, np.bincount(place, weights=inner[rare], minlength=len(word)).astype(np.int64)))
                size += len(word)
                if size > 2 * ADDED:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > ADDED:
                        yield row(*held.pop())
                        size = 0
        if held:
            yield row(*_merged(held))
        some = np.flatnonzero(ranked[:h])
        yield row(some, ranked[some], context[some])
        some = np.flatnonzero(core)
        yield row(head.size + some, core[some], np.zeros(len(some), np.int64))

    return run


def _backed_off(c: np.ndarray, total: int) -> np.ndarray:
    return np.log(BACKOFF) + np.log(c) - np.log(total)


#: What a row about a document itself holds in o: kinds in place of tf. Four columns of numbers are all that is sorted.
_WORDS, _FOUND, _VALUE, _ID = -1, -2, -3, -4


def _exploded(head: Head):
    """Rows (g, o, doc, tf). Pairs of ranked words: g = v << 32 | w, o = 0. An unranked w: g = w + 1, o = v, the rank
    head.size standing for the missing context of a first word. An unranked v: g = v, o = w. And rows for each document:
    its words, what ranks and core pairs settle (the value bit by bit), and its id unless that is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, n = Coder(head), head.core_size
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, sizes, codes in coder.groups(b.column(0)):
                m = len(sizes)
                doc = np.repeat(np.arange(m), sizes)
                inside = doc[:-1] == doc[1:]
                own, v, w = doc[1:][inside], codes[:-1][inside], codes[1:][inside]
                # Pairs of one document that are alike: the document in the upper bits, 57 bits of the pair's hash below.
                pair = own.astype(np.uint64) << np.uint64(57) | _mixed(v.view(np.uint64) * np.uint64(_BASE) + w.view(np.uint64)) >> np.uint64(7)
                order = np.argsort(pair)
                start = np.flatnonzero(np.diff(pair[order], prepend=~pair[order[:1]]))
                tf = np.diff(start, append=len(order))
                own, v, w = (x[order[start]] for x in (own, v, w))
                begin = np.flatnonzero(sizes)
                opening = codes[(np.cumsum(sizes) - sizes)[begin]]
                val, found = np.zeros(m), np.zeros(m, np.int64)
                common = opening >= 0
                val[begin[common]] = _backed_off(head.counts[opening[common]], head.total)
                core = (v >= 0) & (v < n) & (w >= 0) & (w < n)
                if core.any():
                    cv, cw, ct, at = v[core], w[core], tf[core], own[core]
                    others = head.core[cv * n + cw] - ct
                    seen = others > 0
                    near = np.log(np.maximum(others, 1)) - np.log(np.maximum(head.contexts[cv], 1))
                    each = ct * np.where(seen, near, _backed_off(head.counts[cw], head.total))
                    val += np.bincount(at, weights=each, minlength=m)
                    found += np.bincount(at, weights=ct * seen, minlength=m).astype(np.int64)
                ranked, by_w, by_v, rare = np.flatnonzero((v >= 0) & (w >= 0) & ~core), np.flatnonzero(w < 0), np.flatnonzero(v < 0), ~common
                docs = first + np.arange(m)
                first += m
                ids = b.column(1)[lo : lo + m]
                known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
                spread = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
                each = np.arange(m)
                g = [v[ranked] << 32 | w[ranked], w[by_w] + 1, v[by_v], opening[rare] + 1, spread, spread, spread, spread[known]]
                o = [
                    np.zeros(len(ranked), np.int64), v[by_w], w[by_v], np.full(rare.sum(), head.size), sizes, found, val.view(np.int64),
                    ids.drop_null().to_numpy()
                ]
                at = [own[ranked], own[by_w], own[by_v], begin[rare], each, each, each, known]
                times = [tf[ranked], tf[by_w], tf[by_v], np.ones(rare.sum(), np.int64)]
                times += [np.full(len(x), kind) for x, kind in zip(at[4:], (_WORDS, _FOUND, _VALUE, _ID))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (g, o)] + [pa.array(docs[np.concatenate(at)]), pa.array(np.concatenate(times))],
                    ["g", "o", "doc", "tf"]
                )

    return run


def order_of(g: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The number that rows are sorted by; _ORDER is the same as a Column. Rows of a pair have the same number, those of
    an unranked word follow each other, and its count (o = 0) is among the first of them."""
    u = o.view(np.uint64)
    low = ((u ^ u >> np.uint64(21) ^ u >> np.uint64(43)) & np.uint64(_LOW)).astype(np.int64)
    return np.where(g < 0, g >> 24 << 24 | low, g)


_ORDER = f"CASE WHEN g < 0 THEN shiftleft(shiftright(g, 24), 24) | ((o ^ shiftrightunsigned(o, 21) ^ shiftrightunsigned(o, 43)) & {_LOW}L) ELSE g END"


def _joined(head: Head, step: int):
    names = ["doc", "val", "found", "words", "id"]

    def settle(g: np.ndarray, o: np.ndarray, doc: np.ndarray, tf: np.ndarray, table: tuple) -> tuple[pa.RecordBatch, tuple]:
        """Pairs that are here whole, with the counts of their unranked words among them or in table (code, count)."""
        by = np.lexsort((o, g))
        g, o, doc, tf = g[by], o[by], doc[by], tf[by]
        counts = doc < 0
        code, c = np.append(table[0], g[counts]), np.append(table[1], tf[counts])
        by = np.argsort(code)
        code, c = code[by], c[by]
        last = int(g[-1]) >> 24 if len(g) else 0
        g, o, doc, tf = g[~counts], o[~counts], doc[~counts], tf[~counts]
        start = np.flatnonzero((np.diff(g, prepend=0) != 0) | (np.diff(o, prepend=0) != 0) | (np.arange(len(g)) == 0))
        pair = np.repeat(np.add.reduceat(tf, start), np.diff(start, append=len(g))) if len(g) else tf
        rare = g < 0
        by_w, by_v = rare & (g & 1 == 1), rare & (g & 1 == 0)
        count = np.zeros(len(g), np.int64)
        count[rare] = c[np.searchsorted(code, g[rare])]
        v, w = np.where(rare, np.where(by_w, o, -1), g >> 32), np.where(rare, np.where(by_v, o, -1), g & 0xFFFFFFFF)
        others = np.where(by_w & (o == head.size), 0, pair - tf)
        seen = others > 0
        val = np.zeros(len(g))
        # The pair's count and the backed-off word are added once: not where a pair of unranked words is at its context.
        once = ~(by_v & (o < 0))
        at = seen & once
        val[at] += tf[at] * np.log(others[at])
        at = seen & (v >= 0)
        val[at] -= tf[at] * np.log(head.contexts[v[at]])
        at = seen & by_v
        val[at] -= tf[at] * np.log(count[at])
        at = ~seen & (w >= 0)
        val[at] += tf[at] * _backed_off(head.counts[w[at]], head.total)
        at = ~seen & by_w
        val[at] += tf[at] * _backed_off(count[at], head.total)
        docs, at = np.unique(doc, return_inverse=True)
        found = np.bincount(at, weights=tf * (seen & once), minlength=len(docs)).astype(np.int64)
        columns = [pa.array(docs), pa.array(np.bincount(at, weights=val, minlength=len(docs))), pa.array(found)]
        keep = code >> 24 == last  # the next rows may be of the same words
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(docs), pa.int64())] * 2], names), (code[keep], c[keep])

    def of_documents(o: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        found, val = np.where(kind == _FOUND, o, 0), np.where(kind == _VALUE, o, 0).view(np.float64)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(val), pa.array(found), *(pa.array(o, mask=kind != k) for k in (_WORDS, _ID))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, table = [], 0, (np.empty(0, np.int64), np.empty(0, np.int64))
        for b in batches:
            rows = [b.column(i).to_numpy() for i in range(4)]
            about = rows[3] < 0
            if about.any():
                yield of_documents(*(x[about] for x in rows[1:]))
                rows = [x[~about] for x in rows]
            held.append(rows)
            n += len(rows[0])
            if n >= step:
                rows = [np.concatenate(x) for x in zip(*held)]
                cut = np.flatnonzero(np.diff(order_of(rows[0], rows[1])))
                at = cut[-1] + 1 if len(cut) else 0
                if at:
                    out, table = settle(*(x[:at] for x in rows), table)
                    yield out
                held, n = [[x[at:] for x in rows]], len(rows[0]) - at
        if n:
            yield settle(*(np.concatenate(x) for x in zip(*held)), table)[0]

    return run


def _head(docs: DataFrame, text: DataFrame, head_size: int, core_size: int, sample: int) -> tuple[Head, DataFrame]:
    """The ranked words with all counts, and the count table (code, c, cc) of the others."""
    counts = "code bigint, c bigint, cc bigint"
    share = min(1.0, sample / max(1, docs.count()))
    some = text if share == 1 else text.sample(share, seed=1)
    often = some.mapInArrow(_counted(Head(size=head_size, core_size=core_size)), counts).groupBy("code").agg(F.sum("c").alias("c"))
    # What reaches the driver is bounded: head_size words, later their counts and core_size squared sums.
    codes = often.where("code < 0").orderBy(F.desc("c"), "code").limit(head_size).toPandas()["code"].to_numpy(np.int64)
    first = Head(codes, size=head_size, core_size=core_size)
    every = shelve(text.mapInArrow(_counted(first), counts).groupBy("code").agg(F.sum("c").alias("c"), F.sum("cc").alias("cc")))
    fixed = every.where("code >= 0").toPandas()
    code, c, cc = (fixed[x].to_numpy(np.int64) for x in ("code", "c", "cc"))
    is_word = code < head_size
    words, contexts, core = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.zeros(core_size**2, np.int64)
    words[code[is_word]], contexts[code[is_word]] = c[is_word], cc[is_word]
    core[code[~is_word] - head_size] = c[~is_word]
    total = int(words.sum()) + int(every.where("code < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    return Head(codes, words, contexts, total, core, head_size, core_size), every.where("code < 0")


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD, core_size: int = CORE, step: int = STEP, sample: int = SAMPLE
) -> DataFrame:
    """(id_col, n_words, n_found, log_score) for each row of docs.

    n_found: words whose pair with the word before them other documents hold. log_score: the mean described above, null
    for a text without words (empty or null). Rows stand for themselves, also where ids are null or repeat; repeated
    rows count as other documents to each other. Texts of any length are counted and scored whole, in memory that grows
    with the longest one. Rows out of a shuffle are written before they are numbered, so that a lost executor changes no
    score. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    kind = docs.select(column(docs, id_col)).schema[0].dataType
    if not isinstance(kind, IntegralType):  # other ids are numbered, and found again by their number
        ids = shelve(docs.select(column(docs, id_col).alias("of")).distinct().select("of", F.monotonically_increasing_id().alias("number")))
        numbered = docs.select(
            column(docs, id_col).alias("id"), column(docs, text_col).alias("text")
        ).join(ids, F.col("id").eqNullSafe(F.col("of"))).select("number", "text")
        scored = score(numbered, "number", "text", head_size, core_size, step, sample).join(ids, "number")
        return scored.select(F.col("of").alias(id_col), "n_words", "n_found", "log_score")
    docs = steady(docs, id_col, text_col)  # documents are numbered by their place in a task
    text = docs.select(text_bytes(column(docs, text_col)).alias("text"))
    head, rest = _head(docs, text, head_size, core_size, sample)
    body = docs.select(text_bytes(column(docs, text_col)).alias("text"), column(docs, id_col).cast("long").alias("id"))
    pairs = body.mapInArrow(_exploded(head), "g bigint, o bigint, doc bigint, tf bigint")
    roles = F.explode(F.array(
        F.struct((F.col("code") + 1).alias("g"), F.col("c").alias("tf")), F.struct(F.col("code").alias("g"), F.col("cc").alias("tf"))
    )).alias("r")
    table = rest.select(roles).selectExpr("r.g AS g", "0L AS o", "-1L AS doc", "r.tf AS tf")
    rows = pairs.unionByName(table).repartition("g").sortWithinPartitions(F.expr(_ORDER))
    sums = rows.mapInArrow(_joined(head, step), "doc bigint, val double, found bigint, words bigint, id bigint")
    out = sums.groupBy("doc").agg(F.sum("val").alias("val"), F.sum("found").alias("n_found"), F.max("words").alias("n_words"), F.max("id").alias("id"))
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_words", "n_found", F.when(F.col("n_words") > 0, F.col("val") / F.col("n_words")).alias("log_score")
    )
