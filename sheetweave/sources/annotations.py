"""Annotation files: one JSON document per tile, a list of them, or one for a whole image; and the page documents written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUM = T.ArrayType(T.DoubleType())


def _item(box: str, label: str) -> T.StructType:
    return T.StructType([
        T.StructField(box, _NUM), T.StructField(label, T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("source_tiles", T.ArrayType(T.StringType()))
    ])


#: JSON names of the three lists, with the names of an item's geometry and label (fixed values).
LISTS = {
    "object": ("OBJECT/COMPONENT", "object_Bounding_Box", "classification_type"), "ocr": ("OCR", "content_bbox", "text_extracted"),
    "arrow": ("Annotation Arrow", "Points", "class_id")
}
ANNOTATION = T.StructType([
    T.StructField("Image ID", T.StringType()), T.StructField("Tile ID", T.StringType()),
    *[T.StructField(name, T.ArrayType(_item(box, label))) for name, box, label in LISTS.values()],
    T.StructField("tile_box", T.ArrayType(T.IntegerType())),
])


def parse(documents: DataFrame, col: str = "value") -> DataFrame:
    """documents with `ann`, one row per annotation: a list gives one row each. Malformed text fails."""
    as_list = F.when(F.ltrim(col).startswith("["), F.col(col)).otherwise(F.concat(F.lit("["), F.col(col), F.lit("]")))
    parsed = F.from_json(as_list, T.ArrayType(ANNOTATION), {"mode": "FAILFAST"})
    return documents.select(*[c for c in documents.columns if c != col], F.explode(parsed).alias("ann"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")))


def to_detections(annotations: DataFrame, by: tuple = ("path",)) -> DataFrame:
    """(by, image_id, tile_id, kind, item_idx, g0..g3, label, confidence): the flat form. Geometry must have four numbers."""
    parts = []
    for kind, (name, box, label) in LISTS.items():
        rows = annotations.select(
            *by, F.col("ann.`Image ID`").alias("image_id"), F.col("ann.`Tile ID`").alias("tile_id"), F.lit(kind).alias("kind"),
            F.posexplode(F.col(f"ann.`{name}`")).alias("item_idx", "i")
        )
        four = F.when(F.size(f"i.{box}") == 4, F.col(f"i.{box}")).otherwise(F.raise_error(F.lit("geometry must have 4 values")).cast(_NUM))
        rows = rows.withColumn("g", four)
        parts.append(rows.select(
            *by, "image_id", "tile_id", "kind", "item_idx", *[F.col("g")[i].alias(f"g{i}") for i in range(4)], F.col(f"i.{label}").alias("label"),
            F.col("i.confidence").alias("confidence")
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tile_boxes(annotations: DataFrame, by: tuple = ("path",)) -> DataFrame:
    """(by, tile_id, tx, ty, tw, th) of annotations that state their tile's box; one of other than four numbers fails."""
    rows = annotations.where("ann.tile_box IS NOT NULL").select(*by, F.col("ann.`Tile ID`").alias("tile_id"), F.col("ann.tile_box").alias("box"))
    four = F.when(F.size("box") == 4, F.col("box")).otherwise(F.raise_error(F.lit("a tile box must have 4 values")).cast("array<int>"))
    return rows.withColumn("box", four).select(*by, "tile_id", *[F.col("box")[i].alias(c) for i, c in enumerate(("tx", "ty", "tw", "th"))])


def to_annotations(detections: DataFrame, by: tuple = ("image_id", "tile_id")) -> DataFrame:
    """(by, value): one JSON document per group, lists in item order; nulls are left out."""
    lists = []
    for kind, (name, box, label) in LISTS.items():
        geometry = F.array(*[F.col(f"g{i}") for i in range(4)])
        item = F.struct("item_idx", F.struct(geometry.alias(box), F.col("label").alias(label), "confidence").alias("i"))
        lists.append(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item))), lambda x: x["i"]).alias(name))
    grouped = detections.groupBy(*by).agg(*lists)
    head = [F.col(c).alias({"image_id": "Image ID", "tile_id": "Tile ID"}.get(c, c)) for c in by]
    return grouped.select(*by, F.to_json(F.struct(*head, *[f"`{n}`" for n, _, _ in LISTS.values()])).alias("value"))
