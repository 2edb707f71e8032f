"""Detections derived from the driver's events table; every expression has the same value in DuckDB.

Every event gives an object, a text and an arrow. 25 consecutive events share a page, so pages grow with the table; the
dense variant puts a fortieth of all users' events on each page, whatever the table's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetweave.operators import layouts
from sheetweave.operators.slicing import slice_boxes, slice_segments
from sheetweave.settings import Settings
from sheetweave.spread import spread

PAGE = "event_id DIV 25"
DENSE = "user_id % 40"
KINDS = ("object", "ocr", "arrow")


def truth(spark: SparkSession, sf_dir: str, kind: str, page: str = PAGE) -> DataFrame:
    """(page, id, kind, g0..g3, label, confidence) on the canvas."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    conf = "CAST((event_id * 37) % 100 AS DOUBLE) / 100"
    if kind == "object":
        g = ("(event_id * 7919) % 3700", "(event_id * 6007 + user_id * 211) % 2500", "40 + (event_id * 31) % 350", "30 + (event_id * 17) % 320")
        label = "event_type"
    elif kind == "ocr":
        g = ("(event_id * 7907) % 3800", "(event_id * 5987 + user_id * 97) % 2700", "60 + (event_id * 13) % 200", "16 + (event_id * 7) % 30")
        label = "concat('M', CAST(event_id % 97 AS STRING), ' ', upper(event_type))"
    else:
        g = (
            "(event_id * 7901) % 3000", "(event_id * 5981 + user_id * 89) % 2800", "(event_id * 7901) % 3000 + 200 + (event_id * 29) % 880",
            "(event_id * 5981 + user_id * 89) % 2800 + event_id % 3"
        )
        label = "CASE WHEN event_id % 4 = 0 THEN 'leader_line' ELSE 'dimension_line' END"
    geometry = [f"CAST({x} AS DOUBLE) AS g{i}" for i, x in enumerate(g)]
    return e.selectExpr(f"{page} AS page", "event_id AS id", f"'{kind}' AS kind", *geometry, f"{label} AS label", f"{conf} AS confidence")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of 25 tiles for each page: columns, tile size and overlap (also none) by page; some tiles wider, higher or out of line."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", f"{PAGE} AS page", "CAST(event_id % 25 AS INT) AS idx", "3 + (event_id DIV 25) % 4 AS across", "600 + 50 * ((event_id DIV 25) % 5) AS size",
        "CAST(64 * ((event_id DIV 25) % 3) AS INT) AS over",
    )
    return e.selectExpr(
        "page", "idx", "format_string('T%02d', idx) AS tile_id", "CAST((idx % across) * (size - over) AS DOUBLE) AS tx",
        "CAST((idx DIV across) * (size - over) + (CASE WHEN idx % 11 = 7 THEN 1 ELSE 0 END) AS DOUBLE) AS ty",
        "CAST(size + (CASE WHEN event_id % 5 = 0 THEN 180 ELSE 0 END) AS DOUBLE) AS tw", "CAST(size + (CASE WHEN event_id % 7 = 0 THEN 60 ELSE 0 END) AS DOUBLE) AS th",
    )


def layout_detections(spark: SparkSession, sf_dir: str, s: Settings) -> DataFrame:
    """Objects seen through their page's own tiles; a tile's items are counted by id."""
    seen = layouts.cut_boxes(truth(spark, sf_dir, "object"), layout(spark, sf_dir), s.min_visible)
    w = Window.partitionBy("page", "tile_id").orderBy("id")
    return seen.withColumn("item_idx", F.row_number().over(w) - 1).select("page", "id", "tile_id", "kind", "item_idx", "g0", "g1", "g2", "g3", "label", "confidence")


def detections(spark: SparkSession, sf_dir: str, s: Settings, kind: str | None = None, page: str = PAGE) -> DataFrame:
    """Truth seen through tiles, as a model would report it: item_idx counts within page, tile and kind by id."""
    parts = []
    for k in (kind,) if kind else KINDS:
        rows = truth(spark, sf_dir, k, page)
        parts.append(slice_segments(rows, s) if k == "arrow" else slice_boxes(rows, s, s.min_text_visible if k == "ocr" else s.min_visible))
    out = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("page", "tile_id", "kind").orderBy("id")
    numbered = out.withColumn("item_idx", F.row_number().over(w) - 1)
    return numbered.select("page", "id", "tile_idx", "tile_id", "kind", "item_idx", "g0", "g1", "g2", "g3", "label", "confidence")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, x, y): pixels of three strokes through the middle of a tile for each supplier, one of them dashed; some cross."""
    s = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")).selectExpr("s_suppkey AS tile", "explode(sequence(0, 2)) AS k")
    s = s.selectExpr("tile", "k", "90 + (tile * 13 + k * 29) % 80 AS n", "tile * 7 + k * 41 AS turn", "(tile * 5 + k * 3) % 4 AS way")
    s = s.selectExpr("*", "turn % (2 * n + 1) - n AS d").selectExpr("*", "explode(sequence(0L, n)) AS i").where("k <> 1 OR i % 10 < 8")
    s = s.selectExpr("*", "128 - n DIV 2 + i AS major", "CAST(128 + 9 * k + floor(((2 * i - n) * d + n) / (2.0D * n)) AS BIGINT) AS minor")
    return s.selectExpr("tile", "IF(way < 2, major, minor) AS x", "IF(way < 2, minor, major) AS y")
