"""Detections as a stream: pages are merged as they arrive, job states follow their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.operators import merging
from sheetweave.settings import Settings

SCHEMA = "page int, tile_idx int, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string, confidence double"


def merge_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, s: Settings, available_now: bool = True):
    """Parquet files of detections, whole pages in each, merged per micro-batch into sink/batch=<n>.

    A batch that runs again after a failure overwrites what it wrote, so the sink holds each page once."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def put(batch: DataFrame, n: int) -> None:
        merging.merge(merging.apply_thresholds(batch, s), s).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_rates(logs: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Requests per path and window of a streaming log (ts, path, latency_ms); late rows beyond the delay are dropped."""
    return logs.withWatermark("ts", delay).groupBy(F.window("ts", window), "path").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"))


def log_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True):
    """Request records (JSON lines of ts, path, status_code, latency_ms) appended to a table as they arrive, one row each,
    without health checks; a record that does not parse is left out and never stops the stream."""
    rows = spark.readStream.schema("ts timestamp, path string, status_code int, latency_ms double").option("mode", "DROPMALFORMED").json(source)
    rows = rows.where(~F.col("path").isin("/healthz", "/readyz"))
    rows = rows.withColumns({"path": F.substring("path", 1, 512), "latency_ms": F.round("latency_ms", 2)})
    writer = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
