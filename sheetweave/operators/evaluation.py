"""Evaluation and promotion of models, and the relational parts of the fallback predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.operators.running import MAX, as_of, running


def character_errors(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row (cer, exact, n) over (truth, read): edits over characters of the truth (1 at least each)."""
    rows = pairs.limit(limit) if limit else pairs
    return rows.agg(
        (F.sum(F.levenshtein("truth", "read")) / F.sum(F.greatest(F.lit(1), F.length("truth")))).alias("cer"),
        F.avg((F.col("truth") == F.col("read")).cast("double")).alias("exact"), F.count("*").alias("n")
    )


def promotions(versions: DataFrame, parts: int | None = None) -> DataFrame:
    """(model, version, metric) with promoted: the first with a metric, then each strictly better than all before it. A
    model's versions are not brought to one task."""
    best = running(versions, ["model"], [F.col("version").asc()], {"_best": (MAX, F.col("metric"))}, before=True, parts=parts)
    return best.withColumn("promoted", F.coalesce(F.col("metric") > F.col("_best"), F.col("_best").isNull())).drop("_best")


def champions(tried: DataFrame, parts: int | None = None) -> DataFrame:
    """Of models tried (model, version, ts, metric) those that became champion: (model, ts, version, metric). Only a metric
    strictly above all earlier ones takes the place; of several at one time the best, and of equals the earlier version."""
    order = Window.partitionBy("model", "ts").orderBy(F.desc_nulls_last("metric"), "version")
    once = tried.where("metric IS NOT NULL AND ts IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    best = running(once, ["model"], [F.col("ts").asc()], {"_best": (MAX, F.col("metric"))}, before=True, parts=parts)
    return best.where("_best IS NULL OR metric > _best").select("model", "ts", "version", "metric")


def at_the_time(jobs: DataFrame, tried: DataFrame, baselines: DataFrame, parts: int | None = None) -> DataFrame:
    """jobs (job_id, model, ts, ..) with the champion `version` and the `baseline` of its model that held when the job came.
    baselines: (model, ts, baseline); of several at one time the least holds. Both are null before the first."""
    known = as_of(jobs, champions(tried, parts), ["model"], "ts", ["version"], [F.col("version").asc()], parts)
    return as_of(known, baselines, ["model"], "ts", ["baseline"], [F.col("baseline").asc()], parts)


def word_lines(words: DataFrame, by: tuple = ("page",)) -> DataFrame:
    """OCR words (block, par, line, left, top, width, height, conf, text) as lines: box, text from left to right, mean confidence."""
    rows = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    item = F.struct("left", "top", "text")
    out = rows.groupBy(*by, "block", "par", "line").agg(
        F.min("left").alias("x"), F.min("top").alias("y"), F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda w: w["text"]), " ").alias("text"), (F.avg("conf") / 100).alias("confidence"),
    )
    return out.withColumns({"w": F.col("x2") - F.col("x"), "h": F.col("y2") - F.col("y")}).drop("x2", "y2")


def longest_lines(lines: DataFrame, by: tuple = ("page", "tile_id"), most: int = 150) -> DataFrame:
    """The longest lines of each tile, ties in the order given, with a score from length over the tile's diagonal."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("len"), "ord"))
    return lines.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("score", F.least(F.lit(0.95), F.lit(0.3) + F.col("len") / F.col("diag")))


def contour_gate(contours: DataFrame) -> DataFrame:
    """Contours (w, h, area, tw, th) that can be components, with their score."""
    box, tile = F.col("w") * F.col("h"), F.col("tw") * F.col("th")
    fill = F.col("area") / box
    rows = contours.where((box >= 0.004 * tile) & (box <= 0.6 * tile) & (F.least("w", "h") >= 24) & (fill >= 0.15))
    return rows.withColumn("score", F.least(F.lit(0.99), 0.4 + 0.5 * fill))


def text_gate(regions: DataFrame) -> DataFrame:
    """Regions (w, h, density) that can be text."""
    return regions.where("h BETWEEN 6 AND 90 AND w >= 6 AND w <= 25 * h AND density BETWEEN 0.08 AND 0.7")


def readable(texts: DataFrame, least: float = 0.3) -> DataFrame:
    """Texts with a letter or digit and enough confidence."""
    return texts.where(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.col("conf") >= least))


def resolve_models(registry: DataFrame) -> DataFrame:
    """(model, alias, version): the newest complete version of each alias."""
    return registry.where("complete").groupBy("model", "alias").agg(F.max("version").alias("version"))


def last_metrics(log: DataFrame, key: str) -> DataFrame:
    """(run, value): of each run's log lines (line, text), the number under `key` in the last line that is JSON."""
    rows = log.where(F.try_parse_json("text").isNotNull())
    last = rows.groupBy("run").agg(F.max_by("text", "line").alias("text"))
    return last.select("run", F.get_json_object("text", f"$.{key}").try_cast("double").alias("value"))
