"""Ground truth cut into tiles. No join: the tiles that a box can meet follow from its edges and the axis starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.operators.tiling import tile_starts
from sheetweave.settings import Settings


def _axis(length: int, s: Settings) -> Column:
    """A row of struct(n, at) for each tile of one axis."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(at).alias("at")) for n, at in enumerate(tile_starts(length, s.tile_size, s.tile_overlap))]))


def _met(at: Column, start: Column, size: Column, s: Settings, inclusive: bool) -> Column:
    """Whether [start, start + size] meets the tile that begins at `at`."""
    if inclusive:
        return (at <= start + size) & (at + s.tile_size >= start)
    return (at < start + size) & (at + s.tile_size > start)


def _over_tiles(items: DataFrame, box: G.Quad, s: Settings, inclusive: bool = False) -> DataFrame:
    """items once for each tile their box meets, with tile_idx, tile_id and the tile's box t0..t3.

    An axis has a few tiles, so all are tried in compiled filters; a filter of arrays and a formatted name are worked out row
    by row outside of that code, and took most of the time of a cut."""
    across, down = (len(tile_starts(n, s.tile_size, s.tile_overlap)) for n in (s.canvas_width, s.canvas_height))
    rows = items.withColumn("_x", _axis(s.canvas_width, s)).where(_met(F.col("_x.at"), box[0], box[2], s, inclusive))
    rows = rows.withColumn("_y", _axis(s.canvas_height, s)).where(_met(F.col("_y.at"), box[1], box[3], s, inclusive))
    idx = F.col("_y.n") * across + F.col("_x.n")
    names = F.array(*[F.lit(f"Tile_{i + 1:03d}") for i in range(across * down)])
    tile = (
        F.col("_x.at"), F.col("_y.at"), F.least(F.lit(s.tile_size), F.lit(s.canvas_width) - F.col("_x.at")),
        F.least(F.lit(s.tile_size), F.lit(s.canvas_height) - F.col("_y.at"))
    )
    return rows.withColumns({
        "tile_idx": idx, "tile_id": F.get(names, idx), **{f"t{i}": v.cast("double") for i, v in enumerate(tile)}
    }).drop("_x", "_y")


def slice_boxes(items: DataFrame, s: Settings, min_visible: float) -> DataFrame:
    """Boxes g0..g3 of the canvas, in tile pixels, for each tile that shows at least min_visible of their area."""
    box, tile = G.quad("g"), G.quad("t")
    rows = _over_tiles(items, box, s)
    seen = G.intersection(box, tile)
    rows = rows.where(G.overlaps(box, tile) & (G.area(seen) >= min_visible * G.area(box)))
    local = (seen[0] - tile[0], seen[1] - tile[1], seen[2], seen[3])
    return rows.withColumns({f"g{i}": v for i, v in enumerate(local)})


def slice_segments(items: DataFrame, s: Settings) -> DataFrame:
    """Segments g0..g3 clipped to each tile, in tile pixels, where at least min_segment is left."""
    rows = _over_tiles(items, G.segment_box(G.quad("g")), s, inclusive=True)
    return clipped(rows, s.min_segment)


def clipped(rows: DataFrame, min_length: float) -> DataFrame:
    """Rows whose segment g0..g3 keeps at least min_length within the box t0..t3, with what is left of it in that box's pixels.

    Where the segment enters and leaves comes out of an explode of one element, so it is worked out once: as a plain column
    the optimizer would write it out in every place that the filters and the result read it."""
    seg, tile = G.quad("g"), G.quad("t")
    at = F.struct(*[v.alias(n) for n, v in zip(("ok", "t0", "t1"), G.clip_range(seg, tile))])
    rows = rows.withColumn("_at", F.explode(F.array(at))).where("_at.ok")
    c = G.stretch(seg, F.col("_at.t0"), F.col("_at.t1"))
    rows = rows.where(G.length(c) >= min_length)
    return rows.withColumns({f"g{i}": v for i, v in enumerate((c[0] - tile[0], c[1] - tile[1], c[2] - tile[0], c[3] - tile[1]))}).drop("_at")
