"""Synthetic drawings with exact truth: 3508 x 2480 pages, 6 to 12 components each, with dimension, leader and section lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.spread import spread

WIDTH, HEIGHT = 3508, 2480
CLASSES = ("Ctype_1", "Ctype_2", "Ctype_3")
LINES = ("dimension_line", "leader_line", "section_arrow")


#: Space around a component, tries to place it, and how many a drawing may have (fixed values).
PAD, TRIES, FEWEST, MOST = 160, 30, 6, 12


def _number(what: str, low: int, high: int, *at: Column) -> Column:
    """low to high, both included, by seed, purpose, drawing and place: a counter-based generator, the same on every run and cluster."""
    key = F.concat_ws("-", F.col("seed").cast("string"), F.lit(what), F.col("drawing").cast("string"), *[c.cast("string") for c in at])
    h = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return (F.lit(low) + F.pmod(h, F.lit(high - low + 1))).cast("int")


def near(a: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a box comes within PAD pixels of a placed component."""
    return (x + w + PAD >= a["x"]) & (a["x"] + a["w"] + PAD >= x) & (y + h + PAD >= a["y"]) & (a["y"] + a["h"] + PAD >= y)


def placed(seeds: DataFrame) -> DataFrame:
    """seeds (drawing, seed, ..) with parts: an array of components (item, x, y, w, h, c), 6 to 12 wanted, none of which comes
    within PAD pixels of another. Each has TRIES tries at a place; one that finds none is left out. One row a drawing,
    dealt evenly over the cluster: components are folded over what was placed before, tries until a place is free."""
    part = "struct<item: int, x: int, y: int, w: int, h: int, c: int>"

    def component(n: Column) -> Column:
        c = _number("class", 0, 2, n)
        w, h = _number("w", 180, 620, n), _number("h", 180, 520, n)
        even = F.least(w, h)
        return F.struct(n.alias("item"), F.when(c == 1, even).otherwise(w).alias("w"), F.when(c == 1, even).otherwise(h).alias("h"), c.alias("c"))

    def place(done: Column, p: Column) -> Column:
        def attempt(found: Column, t: Column) -> Column:
            # A when draws a place only while none is found; an array of one holds it, so that it is drawn once.
            at = F.array(F.struct(_number("x", 200, WIDTH - 1200, p["item"], t).alias("x"), _number("y", 250, HEIGHT - 600, p["item"], t).alias("y")))
            free = F.filter(at, lambda q: ~F.exists(done, lambda a: near(a, q["x"], q["y"], p["w"], p["h"])))
            return F.when(F.size(found) > 0, found).otherwise(free)

        free = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.array().cast("array<struct<x: int, y: int>>"), attempt)
        first = F.transform(free, lambda t: F.struct(p["item"].alias("item"), t["x"].alias("x"), t["y"].alias("y"), p["w"].alias("w"), p["h"].alias("h"), p["c"].alias("c")))
        return F.concat(done, first)

    wanted = F.transform(F.sequence(F.lit(1), _number("n", FEWEST, MOST)), component)
    return spread(seeds).withColumn("parts", F.aggregate(wanted, F.array().cast(f"array<{part}>"), place))


def drawings(seeds: DataFrame, seed: int = 7) -> DataFrame:
    """(drawing, item, kind, g0..g3, label) of one drawing for each row of seeds (drawing): components that keep their distance,
    each with a text above it and a line from its right edge. A drawing's items follow from its number and `seed` alone;
    repeated drawings are equal."""
    rows = placed(seeds.select("drawing").withColumn("seed", F.lit(seed)))
    # The first component always finds a place. A plain explode is given a filter of the array's size, for which all is drawn twice.
    rows = rows.select("drawing", "seed", F.explode_outer("parts").alias("p")).select("drawing", "seed", "p.*")
    rows = rows.withColumns({**{c: F.col(c).cast("double") for c in "xywh"}, "l": _number("line", 0, 2, F.col("item")), "d": _number("text", 0, 999, F.col("item"))})
    name = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(at) + 1)
    end = (F.col("x") + F.col("w"), F.col("y") + F.col("h") / 2)
    row = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("kind", "g0", "g1", "g2", "g3", "label"), v)])
    items = F.array(
        row(F.lit("object"), *[F.col(c) for c in "xywh"], name(CLASSES, "c")),
        row(F.lit("ocr"), F.col("x"), F.col("y") - 40, F.lit(110.0), F.lit(28.0), F.concat(F.lit("Ø"), F.col("d").cast("string"))),
        row(F.lit("arrow"), *end, end[0] + 150, end[1] + (F.col("l") - 1) * 20, name(LINES, "l")),
    )
    return rows.select("drawing", "item", F.explode(items).alias("i")).select("drawing", "item", "i.*")


def pages(drawn: DataFrame) -> DataFrame:
    """Rasters (path, page, height, width, bgr) of drawings(): components as frames, lines as strokes with their extension
    lines at both ends, texts as rows of marks in their boxes. A group is one drawing's items."""

    def page(t: pd.DataFrame) -> pd.DataFrame:
        image = raster(list(t[["kind", "g0", "g1", "g2", "g3"]].itertuples(index=False, name=None)))
        name = f"drawing_{int(t['drawing'].iloc[0]):05d}"
        return pd.DataFrame([(name, 0, HEIGHT, WIDTH, image.tobytes())], columns=["path", "page", "height", "width", "bgr"])

    return drawn.groupBy("drawing").applyInPandas(page, "path string, page int, height int, width int, bgr binary")


def raster(items: list[tuple]) -> np.ndarray:
    """A white sheet with (kind, g0, g1, g2, g3) drawn in black."""
    out = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)

    def stroke(x1: float, y1: float, x2: float, y2: float, width: int = 3) -> None:
        n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        xs, ys = np.linspace(x1, x2, n).astype(int), np.linspace(y1, y2, n).astype(int)
        for d in range(-(width // 2), width - width // 2):
            for e in range(-(width // 2), width - width // 2):
                out[np.clip(ys + d, 0, HEIGHT - 1), np.clip(xs + e, 0, WIDTH - 1)] = 0

    for kind, a, b, c, d in items:
        if kind == "object":
            for line in ((a, b, a + c, b), (a, b + d, a + c, b + d), (a, b, a, b + d), (a + c, b, a + c, b + d)):
                stroke(*line)
        elif kind == "arrow":
            stroke(a, b, c, d)
            for x, y in ((a, b), (c, d)):
                stroke(x, y - 12, x, y + 12, 1)
        else:
            for x in range(int(a) + 4, int(a + c) - 10, 16):
                stroke(x, b + 4, x, b + d - 4, 2)
                stroke(x, b + 4, x + 8, b + d - 4, 2)
    return out
