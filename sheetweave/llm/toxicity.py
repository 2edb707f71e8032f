"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 8-grams (of "<word>", over bytes, hashed into BUCKETS), a
window is the mean of its words, and a softmax over two classes reads it. Vectors and softmax are trained together. A
misspelling never seen shares n-grams with what was seen. Texts are read in overlapping windows, so that a few words
weigh alike in short and in long texts; a text's score is that of its highest window. A toxic document's windows need
not all be toxic: those are taken for training that hold an n-gram much likelier in toxic documents, and half way only
those that the model holds to be toxic keep the label, one for each document at least.

As averaging and the softmax are linear, a trained model is one number for each bucket and a bias.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, give_back, pieces, shelve, text_bytes

BUCKETS = 1 << 20
DIM = 4
GRAMS = (3, 4, 5, 6, 7, 8)
SPAN = 2
STEP = 1
#: Bounds of the sample that the model is fitted on: documents of each class, and bytes of all of them. Texts are taken whole.
TOXIC_DOCS = 800
CLEAN_DOCS = 2400
SAMPLE_BYTES = 32 << 20
#: Windows that one document of the sample adds to the training at most: of a toxic one those most likely toxic, of a clean one half as many
#: of these and half as many by chance. Texts are scored whole.
DOC_WINDOWS = 32
#: Share of the toxic documents of the sample that an n-gram must occur in (of all documents as many) to be trained, and the least number.
LEAST_SHARE, LEAST_SEEN = 0.025, 3
#: Log odds, toxic to clean documents, of an n-gram that marks a window of a toxic document as a likely carrier.
SUSPECT = 2.5
#: Words that a worker remembers.
REMEMBERED = 500_000
#: Digits and signs that stand for letters (fixed values); other ASCII signs are left out of words.
_LIKE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457@$", b"abcdefghijklmnopqrstuvwxyzoieastas")
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in b"@$")


@dataclass(frozen=True)
class Model:
    """weights: of each bucket, float32 bytes; the logit of a window is bias + the mean of its words' mean weights."""

    weights: bytes = field(repr=False)
    bias: float


def split(text: bytes) -> list[bytes]:
    """The words a text is read as."""
    return text.translate(_LIKE, _SIGNS).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, index of its word), sorted by word; each word has one at least."""
    part = 1 << 14
    if len(words) > part:  # piece by piece: the arrays below are many times the text
        pieces = [grams(words[i : i + part]) for i in range(0, len(words), part)]
        return np.concatenate([b for b, _ in pieces]), np.concatenate([o + np.int32(i * part) for i, (_, o) in enumerate(pieces)])
    joined = b"".join([b"<" + w + b">" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    text = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    buckets, owners = [], []
    ends = np.cumsum(sizes)
    for n in GRAMS:
        if len(text) < n:
            continue
        h = np.zeros(len(text) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) ^ text[i : len(text) - n + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.arange(len(h)) + n <= ends[of[: len(h)]]
        buckets.append(((h >> np.uint64(40))[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(of[: len(h)][inside])
    b, o = np.concatenate(buckets), np.concatenate(owners)
    del joined, text, of, buckets, owners
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def word_means(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over each word's n-grams."""
    b, o = grams(words)
    starts = np.flatnonzero(np.diff(o, prepend=-1))
    counts = np.diff(starts, append=len(o))
    return np.add.reduceat(table[b], starts, axis=0) / (counts if table.ndim == 1 else counts[:, None])


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STEP, the last flush with the end."""
    if n <= SPAN:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - SPAN, STEP), n - SPAN)


def fit(texts: list[bytes], toxic: np.ndarray, steps: int = 80, rate: float = 0.1, seed: int = 7, doc_windows: int = DOC_WINDOWS) -> Model:
    """Train on texts with labels 0 or 1, doc_windows windows of each at most. Without texts of both classes the score is near 0 (or 1) for all."""
    rng = np.random.default_rng(seed)
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(x, len(ids)) for x in split(text)], np.int64) for text in texts]
    some = np.array([len(w) > 0 for w in docs], bool)
    if not some.any() or toxic[some].min() == toxic[some].max():
        return Model(np.zeros(BUCKETS, np.float32).tobytes(), 8.0 if some.any() and toxic[some].all() else -8.0)
    g, o = grams(list(ids))
    gram_n = np.bincount(o)
    odds, common = _odds(docs, toxic, g, o)
    suspect = np.full(len(ids), -np.inf, np.float32)
    np.maximum.at(suspect, o, odds[g])
    rows, sizes, owner = [], [], []
    for d, w in enumerate(docs):
        if not len(w):
            continue
        cut = np.lib.stride_tricks.sliding_window_view(w, min(SPAN, len(w)))[windows(len(w))]
        level = suspect[cut].max(axis=1)
        if toxic[d]:
            likely = np.argsort(-level, kind="stable")[:doc_windows]
            pick = np.sort(likely[(level[likely] >= SUSPECT) | (level[likely] >= level.max())])
        else:  # those most like toxic ones, and some at random
            most, chance = np.argsort(-level, kind="stable")[: doc_windows // 2], rng.choice(len(cut), min(len(cut), doc_windows // 2), replace=False)
            pick = np.unique(np.concatenate([most, chance]))
        rows.append(cut[pick].ravel())
        sizes.append(np.full(len(pick), cut.shape[1]))
        owner.append(np.full(len(pick), d))
    own, flat, sizes = np.concatenate(owner), np.concatenate(rows), np.concatenate(sizes)
    del docs, rows, owner
    y = toxic[own].astype(np.float64)
    row_of = np.repeat(np.arange(len(own)), sizes)
    # n-grams too rare to tell anything keep weight 0, and are not trained; nor are words outside the windows.
    in_use = np.bincount(flat, minlength=len(ids)) > 0
    keep = common[g] & in_use[o]
    g, o = g[keep], o[keep]
    live = np.unique(g)
    g = np.searchsorted(live, g).astype(np.int32)
    # One dimension at a time, so that no array of all n-grams times all dimensions is ever held.
    total = lambda to, values, at, n: np.stack([np.bincount(to, weights=v[at], minlength=n) for v in values])

    table = rng.normal(0, 0.1, (DIM, len(live)))
    soft, bias = rng.normal(0, 0.1, (2, DIM)), np.zeros((2, 1))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    params = [table, soft, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        word = total(o, table, g, len(ids)) / gram_n
        mean = total(row_of, word, flat, len(own)) / sizes
        z = soft @ mean + bias
        p1 = 1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50)))
        if t == steps // 2:
            # Which of a toxic document's windows carry it: those the model calls toxic, and the highest in any case.
            top = np.full(len(texts), -1.0)
            np.maximum.at(top, own, p1)
            keep = (y == 0) | (p1 >= 0.5) | (p1 >= top[own])
            weight = np.where(keep, np.where(y == 1, 0.5 / (keep & (y == 1)).sum(), 0.5 / (1 - y).sum()), 0.0)
        d1 = weight * (p1 - y)
        dz = np.stack([-d1, d1])
        dword = total(flat, (soft.T @ dz) / sizes, row_of, len(ids)) / gram_n
        dtable = total(g, dword, o, len(live))
        for k, grad in enumerate((dtable, dz @ mean.T, dz.sum(axis=1, keepdims=True))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[live] = (soft[1] - soft[0]) @ table
    # The highest of many windows tends upwards: the bias puts the line between both classes' highest windows.
    tops = np.array([max(_window_means(split(x), weights, {}), default=0.0) for x in texts])
    cut = _between(tops[toxic == 0], tops[toxic == 1])
    return Model(weights.tobytes(), float(-cut))


def _odds(docs: list[np.ndarray], toxic: np.ndarray, g: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: log odds of occurring in toxic rather than clean documents, and whether it occurs often enough."""
    starts = np.searchsorted(o, np.arange(o[-1] + 2))
    seen = np.zeros((2, BUCKETS), np.float32)
    for w, y in zip(docs, toxic):
        u = np.unique(w)
        if len(u):
            seen[y, np.unique(np.concatenate([g[starts[i] : starts[i + 1]] for i in u]))] += 1
    n = np.bincount(toxic, minlength=2)
    common = seen.sum(axis=0) >= max(LEAST_SEEN, round(LEAST_SHARE * n[1]))
    return np.where(common, np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1)), -np.inf).astype(np.float32), common


def _between(low: np.ndarray, high: np.ndarray) -> float:
    """The line with the least share of either class on the wrong side; where a gap makes none wrong, its middle."""
    at = np.unique(np.concatenate([low, high]))
    lines = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
    wrong = (len(low) - np.searchsorted(np.sort(low), lines)) / max(1, len(low)) + np.searchsorted(np.sort(high), lines) / max(1, len(high))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((lines[best[0]] + lines[best[-1]]) / 2)


def _window_means(words: list[bytes], weights: np.ndarray, known: dict[bytes, float]) -> np.ndarray:
    if not words:
        return np.empty(0)
    new = list(set(words).difference(known))
    if new:
        known.update(zip(new, word_means(new, weights).tolist()))
    sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))])
    starts = windows(len(words))
    ends = np.minimum(starts + SPAN, len(words))
    return (sums[ends] - sums[starts]) / (ends - starts)


def score_text(text: bytes, weights: np.ndarray, bias: float, known: dict[bytes, float]) -> float:
    """0 to 1; a text without words has the score of the bias alone, 0.5 at most."""
    w = _window_means(split(text), weights, known)
    z = bias + w.max() if len(w) else min(bias, -1e-9)
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", doc_windows: int = DOC_WINDOWS) -> Model:
    """Fit on labelled rows that are not held out.

    The sample is bounded: for each class the ids of least hash, TOXIC_DOCS and CLEAN_DOCS at most, and of these, in the
    same order, whole texts while they fit SAMPLE_BYTES / 2 (a text that does not fit is passed over). An id with both
    labels counts as toxic; of rows that share an id the text of least hash counts, whatever the partitioning; labels
    other than 0 and 1, and null ids, are left out; a null text is empty. Without rows of both classes (also in an empty
    table) every text scores alike. What is broadcast and brought to the driver is bounded by that sample. Of each of its
    documents doc_windows windows train at most (see DOC_WINDOWS), as most windows of a toxic text are clean; this bounds
    the driver's memory as the sample does, and more do not find more (README).
    """
    marks = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    classes = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    chosen = classes[0].unionByName(classes[1])
    body = docs.select(column(docs, id_col).alias("doc"), text_bytes(column(docs, text_col)).alias("text"))
    found = body.join(F.broadcast(chosen), F.col("doc") == F.col("id"))  # TOXIC_DOCS + CLEAN_DOCS rows
    by_value = F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")
    held = shelve(found.groupBy("id").agg(by_value).select("id", "r.y", "r.text"))
    sizes = held.select("id", "y", F.octet_length("text").alias("n"), F.xxhash64("id").alias("h")).toPandas().sort_values(["h", "id"])
    fits = []
    for _, part in sizes.groupby("y"):
        room = SAMPLE_BYTES // 2
        for i, n in zip(part["id"].tolist(), part["n"].tolist()):
            if n <= room:
                room -= n
                fits.append((i,))
    wanted = docs.sparkSession.createDataFrame(fits, held.select("id").schema)
    rows = held.join(F.broadcast(wanted), "id").orderBy(F.xxhash64("id"), "id").toArrow()
    texts, toxic = rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.int64)
    del rows
    model = fit(texts, toxic, doc_windows=doc_windows)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> tuple[DataFrame, str]:
    """docs with a score from 0 to 1 of each whole text in a column named `out`, or longer if docs has that; the name too.

    Null and empty texts score as texts without words; texts of any length are read whole. Equal texts score alike; rows
    neither appear nor go, other columns stay whatever their names; an empty table stays empty.
    """
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, known = np.frombuffer(weights, np.float32), {}
        for batch in pieces(texts):
            got = []
            for x in batch:
                if len(known) > REMEMBERED:
                    known.clear()
                got.append(score_text(x.as_py(), table, bias, known))
            yield pa.array(got, pa.float64())

    name = free_name(docs, out)
    return docs.withColumn(name, scored(text_bytes(column(docs, text_col)))), name
