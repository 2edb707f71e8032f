"""Stored files with what is known of them, and image and annotation files out of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions.text import extension


def put(files: DataFrame, store: str) -> None:
    """Add rows (file_id, name, content, content_type, job_id, kind); a day's files lie together."""
    rows = files.withColumns({"length": F.octet_length("content").cast("long"), "stored_at": F.current_timestamp(), "day": F.current_date()})
    rows.write.mode("append").partitionBy("day").parquet(store)


def info(spark: SparkSession, store: str) -> DataFrame:
    """What is known of every file; contents are not read."""
    return spark.read.parquet(store).drop("content")


def get(spark: SparkSession, store: str, file_id: str) -> DataFrame:
    """The row of one file; of several versions the newest. The filter reaches the scan."""
    rows = spark.read.parquet(store).where(F.col("file_id") == file_id)
    return rows.orderBy(F.desc("stored_at")).limit(1)


def export(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training files out of documents (image_id, filename, content, annotation as JSON text): images (path, content) and
    annotations (path, value) of those that have an annotation. A name without an ending counts as a PNG."""
    rows = documents.where(F.col("annotation").isNotNull())
    ending = extension(F.col("filename"))
    name = F.concat(F.lit("images/"), "image_id", F.when(ending == "", ".png").otherwise(ending))
    return rows.select(name.alias("path"), "content"), rows.select(
        F.concat(F.lit("annotations/"), "image_id", F.lit(".json")).alias("path"), F.col("annotation").alias("value")
    )
