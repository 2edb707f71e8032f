"""Rows of few bytes that become much work, dealt over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df in as many partitions as Spark shuffles into, by its keys or else evenly. A small file gives one or two tasks, and
    without a number Spark would gather small shuffles again; both go by bytes, not by what a row is about to become."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
