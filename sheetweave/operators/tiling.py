"""Canvas fit, overlapping tile grids and pairs of neighbouring tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.settings import Settings
from sheetweave.spread import spread


def tile_starts(length: int, tile: int, overlap: int) -> list[int]:
    """Where tiles of one axis begin; the last is flush with the edge."""
    if length <= tile:
        return [0]
    return sorted({*range(0, length - tile, tile - overlap), length - tile})


def starts_column(length: Column, tile: Column, overlap: Column) -> Column:
    """tile_starts as an expression."""
    some = F.sequence(F.lit(0), F.greatest(length - tile - 1, F.lit(0)), F.greatest(tile - overlap, F.lit(1)))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.array_append(some, length - tile)))


def tile_grid(spark: SparkSession, s: Settings) -> DataFrame:
    """(idx, tile_id, row, col, tx, ty, tw, th), row by row. A few rows, fixed by the settings."""
    xs, ys = (tile_starts(n, s.tile_size, s.tile_overlap) for n in (s.canvas_width, s.canvas_height))
    rows = [(
        r * len(xs) + c, f"Tile_{r * len(xs) + c + 1:03d}", r, c, x, y, min(s.tile_size, s.canvas_width - x), min(s.tile_size, s.canvas_height - y)
    ) for r, y in enumerate(ys) for c, x in enumerate(xs)]
    return spark.createDataFrame(rows, "idx int, tile_id string, row int, col int, tx int, ty int, tw int, th int")


def page_grid(pages: DataFrame, s: Settings, by: tuple = ("page",)) -> DataFrame:
    """The grid of each page (by, width, height), whatever its size, as a layout: by, idx, tile_id, tx, ty, tw, th, row by row."""
    step = (F.lit(s.tile_size), F.lit(s.tile_overlap))
    sizes = spread(pages.select(*by, "width", "height"))
    rows = sizes.select("*", starts_column(F.col("width"), *step).alias("xs"), F.posexplode(starts_column(F.col("height"), *step)).alias("row", "ty"))
    rows = rows.select("*", F.posexplode("xs").alias("col", "tx")).withColumn("idx", F.col("row") * F.size("xs") + F.col("col"))
    size = lambda at, n: F.least(F.lit(s.tile_size), F.col(n) - F.col(at))
    return rows.select(*by, "idx", F.format_string("Tile_%03d", F.col("idx") + 1).alias("tile_id"), "tx", "ty", size("tx", "width").alias("tw"), size("ty", "height").alias("th"))


def touching(a: G.Quad, b: G.Quad) -> tuple[Column, G.Quad]:
    """Whether two tiles that share a row or a column overlap or abut, and the box or edge that they share."""
    (ax, ay, ax2, ay2), (bx, by, bx2, by2) = G.corners(a), G.corners(b)
    beside, stacked = (ay == by) & ((ax2 == bx) | (bx2 == ax)), (ax == bx) & ((ay2 == by) | (by2 == ay))
    hit, shared = G.overlaps(a, b), G.intersection(a, b)
    edge_x = (F.least(ax2, bx2), ay, F.lit(0.0), F.least(a[3], b[3]))
    edge_y = (ax, F.least(ay2, by2), F.least(a[2], b[2]), F.lit(0.0))
    over = tuple(F.when(hit, h).when(beside, p).otherwise(q) for h, p, q in zip(shared, edge_x, edge_y))
    return hit | beside | stacked, over


def tile_pairs(grid: DataFrame, margin: int) -> DataFrame:
    """Tiles that share a row or column and overlap or abut: (pair_ord, a, b, orientation, o0..o3 overlap, s0..s3 seam)."""
    def side(t):
        return grid.select(
            F.col("idx").alias(f"{t}i"), F.col("tile_id").alias(t),
            *[F.col(c).cast("double").alias(f"{t}{k}") for k, c in enumerate(("tx", "ty", "tw", "th"))]
        )
    a, b = G.quad("a"), G.quad("b")
    same_row, same_col = a[1] == b[1], a[0] == b[0]
    near, over = touching(a, b)
    found = side("a").join(side("b"), (F.col("ai") < F.col("bi")) & (same_row | same_col) & near)
    found = found.select("ai", "bi", "a", "b", F.when(same_row, "vertical").otherwise("horizontal").alias("orientation"), *[o.alias(f"o{i}") for i, o in enumerate(over)])
    o = G.quad("o")
    seam = (o[0] - margin, o[1] - margin, o[2] + 2 * margin, o[3] + 2 * margin)
    return found.select((F.col("ai") * 10_000 + F.col("bi")).alias("pair_ord"), "a", "b", "orientation", *o, *[v.alias(f"s{i}") for i, v in enumerate(seam)])


def canvas_fit(pages: DataFrame, s: Settings) -> DataFrame:
    """pages (page, orig_w, orig_h, ..) with rotated, scale, new_w, new_h, pad_x, pad_y: portrait pages are turned, then fitted."""
    turned = F.col("orig_h") > F.col("orig_w")
    w, h = F.when(turned, F.col("orig_h")).otherwise(F.col("orig_w")), F.when(turned, F.col("orig_w")).otherwise(F.col("orig_h"))
    out = pages.withColumn("rotated", turned).withColumn("scale", F.least(F.lit(float(s.canvas_width)) / w, F.lit(float(s.canvas_height)) / h))
    new = lambda v: F.greatest(F.lit(1), F.bround(v * F.col("scale"), 0).cast("int"))
    out = out.withColumns({"new_w": new(w), "new_h": new(h)})
    return out.withColumns({
        "pad_x": F.floor((s.canvas_width - F.col("new_w")) / 2).cast("int"), "pad_y": F.floor((s.canvas_height - F.col("new_h")) / 2).cast("int")
    })
