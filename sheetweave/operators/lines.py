"""Lines by votes (Hough): pixels of a line share an angle and a distance from the tile's corner.

Ink comes as runs of a row (y, x0 to x1). Sines are whole numbers of 1 / 65,536 and positions whole pixels, so every engine
finds the same votes. Unlike connected strokes, lines that cross stay two, and dashes one.

The runs are shuffled by tile, once, and sorted, so a task meets its tiles one after the other and no group is opened for
each; a tile's pixels bound what one task gets of a key. A pixel votes 180 times, which as rows is most of the work of a
table, so votes are counted with numpy where they are cast, STEP at a time, and after the peaks are known only their angles
are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sheetweave.operators import predictors
from sheetweave.operators.evaluation import longest_lines
from sheetweave.scratch import kept
from sheetweave.spread import spread

BY = ("page", "tile_id")
#: Least votes and length of a line, and the places that may be missing between two of its dashes (fixed values).
VOTES, SHORTEST, GAP = 60, 60, 4
#: Lines of a tile that are kept, the longest first (fixed value).
MOST = 150
VERSION = "votes:1"
ANGLES, UNIT, HALF, BITS = 180, 1 << 16, 1 << 15, 16
#: How far around a peak (degrees and pixels) only the strongest counts, and how wide a line is to either side.
APART, WIDE = 2, 1


#: Cosine and sine of every degree in 1 / UNIT.
_C, _S = (np.array([round(f(math.radians(a)) * UNIT) for a in range(ANGLES)], np.int64) for f in (math.cos, math.sin))
#: Votes and claims of a tile that are looked at together, places whose votes are counted together (few, so that they stay in the
#: processor's cache and no memory is asked for anew), and places up to which votes are counted in tables of all places.
STEP, BLOCK, DENSE = 1 << 14, 1 << 13, 1 << 24


def ink_runs(tiles: DataFrame, by: tuple) -> DataFrame:
    """(by, y, x0, x1) of the thin ink of tiles (by, tw, th, bgr): dark pixels without those of filled shapes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, r in enumerate(b.itertuples()):
                dark = predictors.ink(np.frombuffer(r.bgr, np.uint8).reshape(r.th, r.tw, 3))
                thin = dark & ~predictors.spread(predictors.shrink(dark, 5, 5), 5, 5)
                edge = np.diff(np.pad(thin, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                y, x0 = np.nonzero(edge == 1)
                x1 = np.nonzero(edge == -1)[1] - 1
                same = b[[*by]].iloc[[i] * len(y)].reset_index(drop=True)
                yield same.assign(y=y.astype(np.int64), x0=x0.astype(np.int64), x1=x1.astype(np.int64))

    schema = StructType([*tiles.select(*by).schema, *[StructField(n, LongType()) for n in ("y", "x0", "x1")]])
    return tiles.select(*dict.fromkeys([*by, "tw", "th", "bgr"])).mapInPandas(run, schema)


def detected(tiles: DataFrame, least: float, by: tuple = ("path", "page", "tile_id"), most: int = MOST) -> DataFrame:
    """(by, kind, item_idx, g0..g3, label, confidence) of the lines in tiles (by, tw, th, bgr): the longest of each tile, those
    with a score of `least`. The ink is written once, as votes and claims both read it."""
    sized = (*by, "tw", "th")
    found = lines(kept(ink_runs(tiles, sized)), sized)
    found = found.withColumns({"ord": F.struct("angle", "rho", "t0"), "diag": F.sqrt(F.col("tw") * F.col("tw") + F.col("th") * F.col("th"))})
    best = longest_lines(found, by, most).withColumn("confidence", F.round("score", 3)).where(F.col("confidence") >= least)
    ends = [F.col(c).alias(f"g{i}") for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return best.select(*by, F.lit("arrow").alias("kind"), (F.col("rank") - 1).alias("item_idx"), *ends, F.lit("line_candidate").alias("label"), "confidence")


def runs_of(points: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, y, x0, x1): pixels (by, x, y), repeated ones once, as the longest runs of a row. Pixels without a place are none."""
    row = Window.partitionBy(*by, "y").orderBy("x")
    some = points.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    stays = some.withColumn("of", F.col("x") - F.dense_rank().over(row))  # the same along a run, and for a pixel that comes again
    return stays.groupBy(*by, "y", "of").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("of")


def _by_tile(runs: DataFrame, by: tuple) -> DataFrame:
    """(key, y, x0, x1): runs that hold ink, shuffled by their tile; as one struct the key is never null."""
    return spread(runs.where("x0 <= x1 AND y IS NOT NULL").select(F.struct(*by).alias("key"), "y", "x0", "x1"), "key")


def _pixels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, each: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the pixels of runs, at most STEP / each at a time."""
    ends = np.cumsum(x1 - x0 + 1)
    step = max(1, STEP // max(1, each))
    for lo in range(0, int(ends[-1]), step):
        at = np.arange(lo, min(lo + step, int(ends[-1])))
        run = np.searchsorted(ends, at, "right")
        yield x1[run] + 1 - (ends[run] - at), y[run]


def _voted(runs: tuple, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angle, rho, votes) of the places that enough pixels of a tile share."""
    y, x0, x1 = runs
    corners = [x * _C + v * _S + HALF >> BITS for x in (x0.min(), x1.max()) for v in (y.min(), y.max())]
    low = int(min(c.min() for c in corners))
    width = int(max(c.max() for c in corners)) - low + 1
    code, n = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, BLOCK // width) if ANGLES * width <= DENSE else ANGLES
    pixels = lambda: _pixels(y, x0, x1, step)
    if (x1 - x0 + 1).sum() <= STEP // step:
        few = list(pixels())
        pixels = lambda: few
    for a in range(0, ANGLES, step):
        c, s = _C[a : a + step], _S[a : a + step]
        start = HALF + (np.arange(len(c)) * width - low << BITS)
        dense = 0
        for x, v in pixels():
            place = x[:, None] * c
            place += v[:, None] * s
            place += start
            place >>= BITS
            if ANGLES * width <= DENSE:
                dense = dense + np.bincount(place.ravel(), minlength=len(c) * width)
                continue
            some, count = np.unique(place, return_counts=True)
            code, of = np.unique(np.concatenate([code, some]), return_inverse=True)
            n, old = np.zeros(len(code), np.int64), n
            np.add.at(n, of, np.concatenate([old, count]))
        if ANGLES * width <= DENSE:
            at = np.flatnonzero(dense >= votes)
            code, n = np.concatenate([code, at + a * width]), np.concatenate([n, dense[at]])
    code, n = code[n >= votes], n[n >= votes]
    return code // width, code % width + low, n


#: Turns and distances from a place to those around it.
_TURN, _AWAY = (v.reshape(-1, 1) for v in np.mgrid[-APART : APART + 1, -APART : APART + 1])


def _peaks(angle: np.ndarray, rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which places (in order of angle and rho) none within APART degrees and pixels surpasses."""
    stays = np.ones(len(n), bool)
    if not len(n):
        return stays
    low, width = rho.min(), rho.max() - rho.min() + 1
    code = angle * width + rho - low
    step = max(1, STEP // len(_TURN))
    for lo in range(0, len(n), step):
        own = np.arange(lo, min(lo + step, len(n)))
        to = angle[own] + _TURN
        seek = np.where((to >= 0) & (to < ANGLES), rho[own], -rho[own]) + _AWAY - low
        wanted = to % ANGLES * width + seek
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        there = (seek >= 0) & (seek < width) & (code[at] == wanted)
        stays[own] = ~(there & ((n[at] > n[own]) | (n[at] == n[own]) & (at < own))).any(axis=0)  # of equal ones the earlier place
    return stays


def _begins(keys: pa.StructArray) -> np.ndarray:
    """Which keys differ from the one before, where null is as null and no number as no number."""
    new = np.zeros(max(0, len(keys) - 1), bool)
    for c in keys.flatten():
        a, b = c.slice(0, len(new)), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], new])[: len(keys)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[tuple[np.ndarray, ...]]]]:
    """Keys and runs (y, x0, x1) of the tiles that end with each batch of sorted rows; a tile goes on over as many as it needs."""
    key, parts = None, []
    whole = lambda: parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts))
    for b in batches:
        if not b.num_rows:
            continue
        keys, ink = b.column("key"), [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1")]
        ends, found = [*np.flatnonzero(_begins(keys))[1:], b.num_rows], ([], [])
        lo = 0
        for i, hi in enumerate(ends):
            if key is not None and (i or _begins(pa.concat_arrays([key, keys.slice(0, 1)]))[1]):
                found[0].append(key), found[1].append(whole())
                parts = []
            key = keys.slice(lo, 1)
            parts.append(tuple(c[lo:hi] for c in ink))
            lo = hi
        if found[0]:
            yield found
    if key is not None:
        yield [key], [whole()]


def _by_group(runs: DataFrame, by: tuple, find, names: tuple[str, ...]) -> DataFrame:
    """(key, angle, c, s, names) that find gives of the runs of each tile."""
    rows = _by_tile(runs, by).sortWithinPartitions("key")
    schema = StructType([rows.schema["key"], StructField("angle", IntegerType()), *[StructField(n, LongType()) for n in ("c", "s", *names)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, inks in _tiles(batches):
            found = [find(ink) for ink in inks]
            angle, *rest = (np.concatenate([f[n] for f in found]) for n in ("angle", *names))
            of = np.repeat(np.arange(len(found)), [len(f["angle"]) for f in found])
            columns = [pa.concat_arrays(keys).take(pa.array(of)), angle.astype(np.int32), _C[angle], _S[angle], *rest]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    return rows.mapInArrow(run, schema)


def peaks(runs: DataFrame, by: tuple = BY, votes: int = VOTES) -> DataFrame:
    """(by, angle, c, s, rho, votes): places with enough votes that none within APART degrees and pixels surpasses; of equal
    ones the smaller angle, then the smaller distance, stays. Angles close: beyond 179 degrees comes 0 with the other sign."""

    def find(ink: tuple) -> dict[str, np.ndarray]:
        angle, rho, n = _voted(ink, votes)
        stays = _peaks(angle, rho, n)
        return {"angle": angle[stays], "rho": rho[stays], "votes": n[stays]}

    return _by_group(runs, by, find, ("rho", "votes")).select("key.*", "angle", "c", "s", "rho", "votes")


def _places(ink: tuple, angle: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(peak, t, own) of places along peaks (strongest first) with ink within WIDE: own where some of it has no stronger peak within APART."""
    found = [np.empty((3, 0), np.int64)]
    for x, y in _pixels(*ink, len(angle)):
        off = np.abs((x[:, None] * _C[angle] + y[:, None] * _S[angle] + HALF >> BITS) - rho)
        best = np.argmax(off <= APART, axis=1)
        i, k = np.nonzero(off <= WIDE)
        t = y[i] * _C[angle[k]] - x[i] * _S[angle[k]] + HALF >> BITS
        found.append(np.unique(np.stack([k, t, -(best[i] == k).astype(np.int64)]), axis=1))
    k, t, own = np.unique(np.concatenate(found, axis=1), axis=1)  # a place's own row comes first
    first = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(t, prepend=0) != 0))
    return k[first], t[first], -own[first]


def lines(runs: DataFrame, by: tuple = BY, votes: int = VOTES, shortest: int = SHORTEST, gap: int = GAP) -> DataFrame:
    """(by, angle, rho, votes, t0, t1, x1, y1, x2, y2, len): straight pieces of ink, from its runs (by, y, x0, x1).

    A peak's line is cut where more than `gap` places in a row have no ink within WIDE pixels. A piece stays if it is long
    enough and at least half of its places have ink that no stronger peak has within APART pixels; so ink that two lines share
    counts for both, and the weaker peaks of one stroke go. Null keys are keys; empty runs (x0 > x1) and empty tables have no
    lines; runs that overlap vote twice, so give each pixel once (`runs_of`)."""

    def find(ink: tuple) -> dict[str, np.ndarray]:
        angle, rho, n = _voted(ink, votes)
        stays = np.flatnonzero(_peaks(angle, rho, n))
        stays = stays[np.argsort(-n[stays], kind="stable")]
        angle, rho, n = angle[stays], rho[stays], n[stays]
        if not len(n):
            return {"angle": angle, "peak": rho, "votes": n, "t0": n, "t1": n}
        k, t, own = _places(ink, angle, rho)
        start = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(t, prepend=0) > gap + 1))
        size = np.diff(start, append=len(k))
        first, last, owned = t[start], t[start + size - 1], np.add.reduceat(own, start)
        long = (last - first >= shortest) & (2 * owned >= size)
        of = k[start][long]
        return {"angle": angle[of], "peak": rho[of], "votes": n[of], "t0": first[long], "t1": last[long]}

    out = _by_group(runs, by, find, ("peak", "votes", "t0", "t1"))
    x, y = (lambda t: (F.col("peak") * F.col("c") - F.col(t) * F.col("s")) / UNIT), (lambda t: (F.col("peak") * F.col("s") + F.col(t) * F.col("c")) / UNIT)
    # From left to right: with the sine never negative, x falls as t grows; an upright line runs downwards.
    ends = [F.when(F.col("s") > 0, f(a)).otherwise(f(b)).alias(n) for n, f, a, b in (("x1", x, "t1", "t0"), ("y1", y, "t1", "t0"), ("x2", x, "t0", "t1"), ("y2", y, "t0", "t1"))]
    return out.select("key.*", "angle", F.col("peak").alias("rho"), "votes", "t0", "t1", *ends, (F.col("t1") - F.col("t0")).cast("double").alias("len"))
