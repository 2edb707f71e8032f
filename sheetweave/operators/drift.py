"""Distribution profiles of detections and their drift against a fixed or rolling baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.settings import Settings

EPS = 1e-4
RATES = ("objects_per_tile", "arrows_per_tile", "ocr_per_tile")
DISTS = ("object_class_dist", "arrow_class_dist")


def profile(detections: DataFrame, tiles: DataFrame, by: tuple = ("page",)) -> DataFrame:
    """(by, n_tiles, two class-share maps, rates per tile, mean_confidence). tiles: (by, n_tiles), empty tiles included.

    Classes are counted first (partial sums), then shares are gathered: a map holds one entry per class."""
    counts = detections.groupBy(*by, "kind", "label").agg(F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.count("confidence").alias("with_conf"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    entries = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("label", "n")))
    per = counts.groupBy(*by).agg(
        of("object").alias("no"), of("arrow").alias("na"), of("ocr").alias("nt"), (F.sum("conf") / F.sum("with_conf")).alias("mean_confidence"),
        entries("object").alias("eo"), entries("arrow").alias("ea")
    )
    out = tiles.join(per, [*by], "left")
    share = lambda e, n: F.coalesce(
        F.map_from_entries(F.transform(F.array_sort(e), lambda x: F.struct(x["label"].alias("key"), (x["n"] / n).alias("value")))),
        F.create_map().cast("map<string,double>")
    )
    n = F.greatest(F.col("n_tiles"), F.lit(1))
    rate = lambda c: F.coalesce(F.col(c), F.lit(0)) / n
    return out.select(
        *by, "n_tiles", share("eo", F.col("no")).alias(DISTS[0]), share("ea", F.col("na")).alias(DISTS[1]), rate("no").alias(RATES[0]),
        rate("na").alias(RATES[1]), rate("nt").alias(RATES[2]), "mean_confidence"
    )


def psi(expected: Column, actual: Column) -> Column:
    """Population stability of two share maps; a class that one lacks counts as EPS. Classes are summed in order."""
    keys = F.array_sort(F.array_union(F.map_keys(expected), F.map_keys(actual)))
    at = lambda m, k: F.greatest(F.coalesce(F.try_element_at(m, k), F.lit(0.0)), F.lit(EPS))
    return F.aggregate(keys, F.lit(0.0), lambda s, k: s + (at(actual, k) - at(expected, k)) * F.log(at(actual, k) / at(expected, k)))


def rate_shift(expected: Column, actual: Column) -> Column:
    """Symmetric relative change, 0 to 2."""
    return F.when((actual == 0) & (expected == 0), F.lit(0.0)).otherwise(F.abs(actual - expected) / F.greatest((F.abs(actual) + F.abs(expected)) / 2, F.lit(EPS)))


def compare(pairs: DataFrame, s: Settings, baseline: str = "baseline", current: str = "current") -> DataFrame:
    """pairs with a struct each of baseline (null: none) and current, plus status, drift, flags and the metrics.

    confidence_drop is null unless both means are there and not 0. Flags compare unrounded values, strictly."""
    b, c = F.col(baseline), F.col(current)
    none = b.isNull()
    m = {
        "object_class_psi": psi(b[DISTS[0]], c[DISTS[0]]),
        "arrow_class_psi": psi(b[DISTS[1]], c[DISTS[1]]),
        **{f"{r}_shift": rate_shift(b[r], c[r]) for r in RATES},
        "confidence_drop": F.when(
            (b["mean_confidence"] != 0) & (c["mean_confidence"] != 0), F.greatest(F.lit(0.0), b["mean_confidence"] - c["mean_confidence"])
        ),
    }
    out = pairs.withColumns({k: F.when(~none, v) for k, v in m.items()})
    limit = lambda k: s.psi_threshold if k.endswith("_psi") else s.shift_limit if k.endswith("_shift") else s.drop_limit
    flags = F.filter(F.array(*[F.when(F.col(k) > limit(k), F.lit(k)) for k in m]), lambda x: x.isNotNull())
    return out.withColumns({"status": F.when(none, "no_baseline").otherwise("ok"), "flags": flags, "drift": F.size(flags) > 0})


def average(profiles: DataFrame, by: tuple = ()) -> DataFrame:
    """One profile per `by`: plain means over profiles with tiles; a class that a profile lacks counts 0 there, missing
    mean confidences are left out, tiles are added up."""
    rows = profiles.where("n_tiles > 0")
    base = rows.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n_tiles").alias("n_tiles"), *[F.avg(r).alias(r) for r in RATES],
        F.avg("mean_confidence").alias("mean_confidence")
    )
    out = base
    for d in DISTS:
        sums = rows.select(*by, F.explode(d).alias("c", "v")).groupBy(*by, "c").agg(F.sum("v").alias("v"))
        maps = sums.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("c").alias("key"), F.col("v").alias("value"))))).alias(d))
        out = out.join(maps, [*by], "left") if by else out.crossJoin(maps)  # one row each
        out = out.withColumn(d, F.transform_values(F.coalesce(F.col(d), F.create_map().cast("map<string,double>")), lambda _, v: v / F.col("k")))
    return out.select(*by, "n_tiles", *DISTS, *RATES, "mean_confidence")


def recent(profiles: DataFrame, limit: int) -> DataFrame:
    """The newest profiles; empty ones are dropped after the limit."""
    return profiles.orderBy(F.desc("created_at")).limit(limit).where("n_tiles > 0")


def rolling(profiles: DataFrame, s: Settings, over: list[str], part: str, order: str = "created_at") -> DataFrame:
    """Backtest of a rolling baseline: for each profile the means of up to rolling_window profiles before it (itself
    excluded) within its part, which keeps the profiles of one task few."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-s.rolling_window, -1)
    return profiles.withColumns({f"base_{c}": F.avg(c).over(w) for c in over})


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest profile of each name."""
    return baselines.groupBy("name").agg(F.max("created_at").alias("created_at"), F.max_by("profile", "created_at").alias("profile"))


def any_drift(pages: DataFrame) -> DataFrame:
    """(job_id, drift): whether any page of a job drifted; a page without a baseline has not."""
    return pages.groupBy("job_id").agg(F.bool_or(F.coalesce(F.col("drift"), F.lit(False))).alias("drift"))


def baseline_of(profiles: DataFrame, name: str = "default") -> DataFrame:
    """The row (name, profile) that is published as a baseline: the profile of the valid split, else of everything.

    profiles: (split, profile struct), with one row for each split and one with split null for all of them."""
    rank = F.when(F.col("split") == "valid", 0).when(F.col("split").isNull(), 1).otherwise(2)
    tiles = F.coalesce(F.col("profile.n_tiles"), F.lit(0)) > 0
    return profiles.where(tiles & (rank < 2)).agg(F.min_by("profile", rank).alias("profile")).select(F.lit(name).alias("name"), "profile").where("profile IS NOT NULL")
