"""A drawing job in three stages, each a set of tables below the job's folder that the next one reads.

files -> preprocess: rasters, pages, tiles -> infer: detections, versions -> postprocess: merged, results, profiles, overlays.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.operators import drift, merging, prediction, results, tiling
from sheetweave.settings import Settings
from sheetweave.sources import images

BY = ("path", "page")


def _table(spark: SparkSession, job: str, name: str, stage: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{job}/{name}")
    except AnalysisException as x:
        raise RuntimeError(f"{job} has no {name}: run {stage} first") from x


def _timed(spark: SparkSession, job: str, stage: str, began: float) -> None:
    took = spark.createDataFrame([(stage, round(time.perf_counter() - began, 3))], "stage string, seconds double")
    took.coalesce(1).write.mode("overwrite").parquet(f"{job}/timings/stage_name={stage}")


def preprocess(spark: SparkSession, files: str, job: str, s: Settings, image: str | None = None, decoders: dict | None = None) -> DataFrame:
    """Files as pages with their canvas transform and name, and as tiles. Returns the pages, without pixels."""
    began = time.perf_counter()
    pages = images.read_pages(spark, files, decoders, s)
    pages.write.mode("overwrite").parquet(f"{job}/rasters")
    pages = spark.read.parquet(f"{job}/rasters")
    images.tiles(pages, s).write.mode("overwrite").parquet(f"{job}/tiles")
    sizes = pages.select(*BY, F.col("width").alias("orig_w"), F.col("height").alias("orig_h"))
    count = sizes.groupBy("path").agg(F.count("*").alias("n_pages"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    named = sizes.join(count, "path").withColumn("image_id", results.image_id(F.lit(image) if image else stem, F.col("page"), F.col("n_pages")))
    tiling.canvas_fit(named, s).write.mode("overwrite").parquet(f"{job}/pages")
    _timed(spark, job, "preprocess", began)
    return spark.read.parquet(f"{job}/pages")


def infer(spark: SparkSession, job: str, s: Settings, suite: prediction.Suite | None = None) -> DataFrame:
    """What the suite's predictors find in each tile."""
    began = time.perf_counter()
    suite = suite or prediction.default_suite(s)
    found = prediction.infer(_table(spark, job, "tiles", "preprocess"), suite, s)
    found.write.mode("overwrite").parquet(f"{job}/detections")
    spark.createDataFrame([(suite.name, suite.version)], "suite string, version string").coalesce(1).write.mode("overwrite").parquet(f"{job}/versions")
    _timed(spark, job, "infer", began)
    return spark.read.parquet(f"{job}/detections")


def postprocess(spark: SparkSession, job: str, s: Settings, baseline: DataFrame | None = None, ask: Callable[[str, str], str] | None = None) -> DataFrame:
    """(path, page, ..) results, one document a page, with its drift against a baseline: one row of the columns of
    drift.average(), the published baseline or the average of recent profiles. Writes merged, results, profiles and overlays."""
    began = time.perf_counter()
    pages, found = _table(spark, job, "pages", "preprocess"), _table(spark, job, "detections", "infer")
    above = merging.apply_thresholds(found.withColumn("tile_idx", F.lit(0)), s)
    merged, report = prediction.merge_pages(above, s, BY, ask)
    merged.write.mode("overwrite").parquet(f"{job}/merged")
    grid = tiling.tile_grid(spark, s).count()
    profile = drift.profile(above, pages.select(*BY, F.lit(grid).alias("n_tiles")), BY)
    profile.write.mode("overwrite").parquet(f"{job}/profiles")
    cols = [*drift.DISTS, *drift.RATES, "mean_confidence"]
    pairs = profile.select(*BY, F.struct(*cols).alias("current"))
    base = baseline.select(F.struct(*cols).alias("baseline")) if baseline is not None else None
    pairs = pairs.crossJoin(F.broadcast(base)) if base is not None else pairs.withColumn("baseline", F.lit(None).cast(pairs.schema["current"].dataType))  # one row
    compared = drift.compare(pairs, s).select(*BY, F.struct("status", "drift", "flags").alias("drift"))
    out = results.page_results(above, merged, pages, report, BY).join(compared, [*BY], "left")
    out.join(pages.select(*BY, "image_id"), [*BY]).write.mode("overwrite").parquet(f"{job}/results")
    overlays(spark, job, s).write.mode("overwrite").parquet(f"{job}/overlays")
    _timed(spark, job, "postprocess", began)
    return spark.read.parquet(f"{job}/results")


def overlays(spark: SparkSession, job: str, s: Settings) -> DataFrame:
    """(path, page, png): each page's canvas with what was merged drawn on it. A group is one page: its raster and items."""
    rasters = _table(spark, job, "rasters", "preprocess")
    drawn = prediction.draw_commands(_table(spark, job, "merged", "postprocess")).select(*BY, "kind", "shape", *[f"g{i}" for i in range(4)])

    def page(key, raster: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        r = raster.iloc[0]
        canvas = images.to_canvas(images.enhance(np.frombuffer(r.bgr, np.uint8).reshape(r.height, r.width, 3)), s)
        commands = list(items[["kind", "shape", "g0", "g1", "g2", "g3"]].itertuples(index=False, name=None))
        return pd.DataFrame([(*key, images.encode_png(images.overlay(canvas, commands)))], columns=[*BY, "png"])

    return rasters.groupBy(*BY).cogroup(drawn.groupBy(*BY)).applyInPandas(page, "path string, page int, png binary")


def run(spark: SparkSession, files: str, job: str, s: Settings, **how) -> DataFrame:
    """All stages. how: image and decoders of preprocess(), suite of infer(), baseline and ask of postprocess()."""
    part = lambda *names: {k: v for k, v in how.items() if k in names}
    preprocess(spark, files, job, s, **part("image", "decoders"))
    infer(spark, job, s, **part("suite"))
    return postprocess(spark, job, s, **part("baseline", "ask"))


def drifted(results_: DataFrame, job_id: str) -> DataFrame:
    """(job_id, drift, pages) of a job's results."""
    return results.job_drift(results_.select(F.lit(job_id).alias("job_id"), F.col("drift.drift").alias("drift")))
