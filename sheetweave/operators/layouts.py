"""Tiles as each page has them: boxes of any size and place, their pairs, and items cut into them.

Tiles: by..., idx (place on the page), tile_id, tx, ty, tw, th. No step compares all tiles of a page, or all items with all
tiles: tiles meet along shared edges of a row or column, items and tiles in cells of a lattice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.operators.slicing import clipped
from sheetweave.operators.tiling import touching

BY = ("page",)
#: Pixels along an axis that share a key of the joins.
CELL = 1024


def numbered(tiles: DataFrame, by: tuple = BY) -> DataFrame:
    """Tiles (by, tile_id, tx, ty, tw, th) with idx, row by row from the top left. Of a tile_id that a page has twice the
    last box in that order stays; boxes without four numbers go."""
    whole = tiles.where(" AND ".join(f"{c} IS NOT NULL" for c in ("tx", "ty", "tw", "th")))
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("ty", "tx", "tw", "th")])
    one = whole.groupBy(*by, "tile_id").agg(F.max(box).alias("t")).select(*by, "tile_id", *[F.col(f"t.{c}").alias(c) for c in ("tx", "ty", "tw", "th")])
    return one.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("ty", "tx", "tile_id")) - 1)


def pairs(tiles: DataFrame, margin: int, by: tuple = BY) -> DataFrame:
    """(by, pair_ord, a, b, orientation, o0..o3 overlap, s0..s3 seam): tiles of a page that share a row or a column and
    overlap or abut; a is the one of smaller idx.

    A tile lies on two lines, its row (ty) and its column (tx), as an interval. Of two that meet, one begins within the
    other, so one side of the join is the cells of intervals and the other the beginnings."""
    box = [F.col(c).cast("double").alias(c) for c in ("tx", "ty", "tw", "th")]
    line = lambda row, at, lo, size: F.struct(F.lit(row).alias("row"), F.col(at).cast("double").alias("at"), F.col(lo).cast("double").alias("lo"), (F.col(lo) + F.col(size)).cast("double").alias("hi"))
    lines = F.explode(F.array(line(True, "ty", "tx", "tw"), line(False, "tx", "ty", "th")))
    ends = tiles.select(*by, F.struct("idx", "tile_id", *box).alias("t"), lines.alias("l")).select(*by, "t", "l.*")
    cell = lambda v: F.floor(F.col(v) / F.lit(float(CELL)))
    over = ends.select(*by, "row", "at", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("t").alias("u"))
    begun = ends.select(*by, "row", "at", cell("lo").alias("cell"), "lo", F.col("t").alias("v"))
    u, v = F.col("u"), F.col("v")
    # Spark takes a table for as large as before its explode and would send it whole to every task.
    met = over.join(begun.hint("merge"), [*by, "row", "at", "cell"]).where(
        F.col("lo").between(F.col("_lo"), F.col("_hi")) & ((F.col("lo") > F.col("_lo")) | (v["idx"] > u["idx"])) & (u["idx"] != v["idx"])
        & (F.col("row") | (u["ty"] != v["ty"]))  # two of one origin share the row too
    )
    first = u["idx"] < v["idx"]
    met = met.select(*by, F.when(first, u).otherwise(v).alias("u"), F.when(first, v).otherwise(u).alias("v"))
    a, b = (tuple(F.col(f"{t}.{c}") for c in ("tx", "ty", "tw", "th")) for t in "uv")
    near, over = touching(a, b)
    rows = met.where(near).select(
        *by, F.shiftleft(F.col("u.idx").cast("long"), 32).bitwiseOR(F.col("v.idx").cast("long")).alias("pair_ord"), F.col("u.tile_id").alias("a"), F.col("v.tile_id").alias("b"),
        F.when(a[1] == b[1], "vertical").otherwise("horizontal").alias("orientation"), *[o.alias(f"o{i}") for i, o in enumerate(over)],
    )
    o = G.quad("o")
    seam = (o[0] - margin, o[1] - margin, o[2] + 2 * margin, o[3] + 2 * margin)
    return rows.select("*", *[x.alias(f"s{i}") for i, x in enumerate(seam)])


def _met(items: DataFrame, box: G.Quad, tiles: DataFrame, by: tuple, inclusive: bool) -> DataFrame:
    """items once for each tile of their page that their box meets, with tile_idx, tile_id and the tile's box t0..t3. They
    meet in the cell in which their common part begins."""

    def cells(b: G.Quad, out: str) -> Column:
        x, y, x2, y2 = (F.floor(v / F.lit(float(CELL))) for v in G.corners(b))
        return F.explode(F.flatten(F.transform(F.sequence(x, x2), lambda i: F.transform(F.sequence(y, y2), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias(out)

    t = [F.col(c).cast("double").alias(f"t{i}") for i, c in enumerate(("tx", "ty", "tw", "th"))]
    sheet = tiles.select(*by, F.col("idx").alias("tile_idx"), "tile_id", *t)
    sheet = sheet.select("*", cells(G.quad("t"), "_c"))
    rows = items.select("*", cells(box, "_c")).join(sheet.hint("merge"), [*by, "_c"])  # see pairs()
    tile = G.quad("t")
    begins = F.struct(*[F.floor(F.greatest(box[k], tile[k]) / F.lit(float(CELL))).alias(n) for k, n in ((0, "i"), (1, "j"))])
    (x, y, x2, y2), (tx, ty, tx2, ty2) = G.corners(box), G.corners(tile)
    meets = (tx <= x2) & (tx2 >= x) & (ty <= y2) & (ty2 >= y) if inclusive else G.overlaps(box, tile)
    return rows.where((F.col("_c") == begins) & meets).drop("_c")


def cut_boxes(items: DataFrame, tiles: DataFrame, min_visible: float, by: tuple = BY) -> DataFrame:
    """Boxes g0..g3 of each page, in tile pixels, for each of its tiles that shows at least min_visible of their area."""
    box, tile = G.quad("g"), G.quad("t")
    rows = _met(items, box, tiles, by, inclusive=False)
    seen = G.intersection(box, tile)
    rows = rows.where(G.area(seen) >= min_visible * G.area(box))
    return rows.withColumns({f"g{i}": v for i, v in enumerate((seen[0] - tile[0], seen[1] - tile[1], seen[2], seen[3]))})


def cut_segments(items: DataFrame, tiles: DataFrame, min_length: float, by: tuple = BY) -> DataFrame:
    """Segments g0..g3 clipped to each tile of their page, in tile pixels, where at least min_length is left."""
    return clipped(_met(items, G.segment_box(G.quad("g")), tiles, by, inclusive=True), min_length)
