"""Commands over the library: python -m sheetweave.cli <command> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sheetweave.operators import datasets, drift, evaluation, prediction, slicing, tiling
from sheetweave.plans import job
from sheetweave.settings import Settings
from sheetweave.sources import synthetic


def _synthetic(spark, s, a):
    synthetic.drawings(spark.range(a.n).withColumnRenamed("id", "drawing"), a.seed).write.mode("overwrite").parquet(a.out)


def _dataset(spark, s, a):
    """Ground truth on the canvas (image_id, kind, id, g0..g3, label) as a training set."""
    truth = spark.read.parquet(a.truth)
    boxes = slicing.slice_boxes(truth.where("kind = 'object'"), s, s.min_visible).unionByName(slicing.slice_boxes(truth.where("kind = 'ocr'"), s, s.min_text_visible))
    found = boxes.unionByName(slicing.slice_segments(truth.where("kind = 'arrow'"), s)).withColumnRenamed("id", "item_idx")
    datasets.write(datasets.build(spark.read.parquet(a.images), found, tiling.tile_grid(spark, s)), a.out)


def _run(spark, s, a):
    job.run(spark, a.files, a.out, s).select("path", "page", "counts", "drift").show(truncate=False)


def _baseline(spark, s, a):
    rows = datasets.read_annotations(spark, a.dataset)
    tiles = spark.read.json(f"{a.dataset}/tiles").groupBy("split").agg(F.count("*").alias("n_tiles"))
    both = rows.withColumn("confidence", F.lit(None).cast("double"))
    per = drift.profile(both, tiles, ("split",))
    every = drift.profile(both.withColumn("split", F.lit("all")), tiles.agg(F.sum("n_tiles").alias("n_tiles")).withColumn("split", F.lit("all")), ("split",))
    cols = ["n_tiles", *drift.DISTS, *drift.RATES, "mean_confidence"]
    profiles = per.unionByName(every.withColumn("split", F.lit(None).cast("string"))).select("split", F.struct(*cols).alias("profile"))
    drift.baseline_of(profiles).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(a.out)


def _prompts(spark, s, a):
    prediction.prompt_log(spark).write.mode("overwrite").parquet(a.out)


def _evaluate(spark, s, a):
    evaluation.character_errors(spark.read.json(a.pairs), a.limit).show()


def _promote(spark, s, a):
    evaluation.promotions(spark.read.parquet(a.versions)).show()


COMMANDS = {
    "synthetic": (_synthetic, {"out": str, "--n": int, "--seed": int}), "dataset": (_dataset, {"images": str, "truth": str, "out": str}),
    "run": (_run, {"files": str, "out": str}), "baseline": (_baseline, {"dataset": str, "out": str}), "prompts": (_prompts, {"out": str}),
    "evaluate": (_evaluate, {"pairs": str, "--limit": int}), "promote": (_promote, {"versions": str}),
}
DEFAULTS = {"--n": 20, "--seed": 7, "--limit": None}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sheetweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (do, arguments) in COMMANDS.items():
        one = commands.add_parser(name, help=do.__doc__)
        for arg, kind in arguments.items():
            one.add_argument(arg, type=kind, **({"default": DEFAULTS[arg]} if arg.startswith("--") else {}))
    given = parser.parse_args(argv)
    COMMANDS[given.command][0](spark or SparkSession.builder.appName("sheetweave").getOrCreate(), Settings.from_env(), given)


if __name__ == "__main__":
    main()
