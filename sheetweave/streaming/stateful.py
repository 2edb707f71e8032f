"""Streams that hold state: pages assembled from tiles that arrive one by one, and jobs that pass through their states.

Both are keyed (by page, by job), so state is spread over the cluster and kept in the state store from checkpoint to
checkpoint; what is held for one key is bounded by a page's tiles or one job's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheetweave.operators import jobs, merging
from sheetweave.settings import Settings
from sheetweave.sources import annotations
from sheetweave.sources.state import StateTable

#: Of a stream of tiles: the page and how many tiles it has, and one tile's annotation as JSON.
TILE = "page string, n_tiles int, tile_id string, value string"
PAGE_OUT = "page string, status string, tile_id string, value string"
EVENT = "job_id string, ts timestamp, status string, error string"
JOB_OUT = "job_id string, ts timestamp, status string, error string, accepted boolean, was string"
#: The state store that keyed processors with timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _started(spark: SparkSession, writer, available_now: bool, seconds: int):
    """Timers need batches without data; a run over what is there now would never end with them, so its timers wait for a later run."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(not available_now).lower())
    try:
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        spark.conf.set(key, before)


class PageAssembly(StatefulProcessor):
    """Holds a page's tiles until all that it has are there, then hands the page on, once.

    Rows out are tiles with the status of their page: `complete`; `incomplete`, when `wait_ms` have passed since the first
    tile; `late`, for a tile that comes when its page is gone. A tile that comes twice while its page waits counts once, as
    it came last. That a page is gone is remembered for `remember_ms`."""

    def __init__(self, wait_ms: int = 600_000, remember_ms: int = 7 * 86_400_000):
        self.wait_ms, self.remember_ms = wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "tile_id string", "value string")
        self.expected = handle.getValueState("expected", "n int")
        self.gone = handle.getValueState("gone", "status string", ttlDurationMs=self.remember_ms)

    def _hand_on(self, page: str, status: str) -> pd.DataFrame:
        rows = sorted((k[0], v[0]) for k, v in self.held.iterator())
        self.held.clear()
        self.expected.clear()
        self.gone.update((status,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        return pd.DataFrame([(page, status, t, v) for t, v in rows], columns=["page", "status", "tile_id", "value"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (page,) = key
        for part in rows:
            late = []
            for n, tile, value in part[["n_tiles", "tile_id", "value"]].itertuples(index=False):
                if self.gone.exists():
                    late.append((page, "late", tile, value))
                    continue
                if not self.expected.exists():
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
                self.expected.update((int(n),))
                self.held.updateValue((tile,), (value,))
                if sum(1 for _ in self.held.keys()) >= n:
                    yield self._hand_on(page, "complete")
            if late:
                yield pd.DataFrame(late, columns=["page", "status", "tile_id", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.gone.exists():
            yield self._hand_on(key[0], "incomplete")

    def close(self) -> None:
        pass


def assemble(tiles: DataFrame, wait_ms: int = 600_000, remember_ms: int = 7 * 86_400_000) -> DataFrame:
    """A stream of tiles (TILE) as one of whole pages (PAGE_OUT)."""
    return tiles.groupBy("page").transformWithStateInPandas(
        statefulProcessor=PageAssembly(wait_ms, remember_ms), outputStructType=PAGE_OUT, outputMode="append", timeMode="processingTime"
    )


def page_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, s: Settings, wait_ms: int = 600_000, available_now: bool = True, seconds: int = 5):
    """Tiles (JSON lines of TILE under source) merged into pages as soon as these are whole.

    sink/merged/batch=<n> holds the merged rows of the pages that batch n handed on, with their status; sink/late the
    tiles that came too late. A batch that runs again writes the same folders again, so no page is there twice."""
    spark.conf.set(*STORE)
    pages = assemble(spark.readStream.schema(TILE).json(source), wait_ms)

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        whole = batch.where("status <> 'late'")
        found = annotations.to_detections(annotations.parse(whole.select("page", "status", "value")), ("page", "status"))
        merging.merge(merging.apply_thresholds(found, s), s, ("page", "status")).write.mode("overwrite").parquet(f"{sink}/merged/batch={n}")
        batch.where("status = 'late'").write.mode("overwrite").parquet(f"{sink}/late/batch={n}")
        batch.unpersist()

    writer = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return _started(spark, writer, available_now, seconds)


class JobStates(StatefulProcessor):
    """Takes the events that may follow a job's state and rejects the others; a job that runs for `limit_ms` fails."""

    def __init__(self, limit_ms: int = 1_800_000):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))[["ts", "status", "error"]]  # one job's events of one batch
        events["rank"] = events["status"].map(jobs.RANK)
        out = []
        for ts, status, error, _ in events.sort_values(["ts", "rank"], kind="stable").itertuples(index=False):
            was = self.state.get()[0] if self.state.exists() else None
            taken = status in jobs.FOLLOWS.get(was, ())
            out.append((key[0], ts, status, error, taken, was))
            if not taken:
                continue
            self.state.update((status,))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status == "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield pd.DataFrame(out, columns=["job_id", "ts", "status", "error", "accepted", "was"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        was = self.state.get()[0] if self.state.exists() else None
        if was == "running":
            self.state.update(("failed",))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([(key[0], at, "failed", f"no end within {self.limit_ms // 1000} s", True, was)], columns=["job_id", "ts", "status", "error", "accepted", "was"])

    def close(self) -> None:
        pass


def follow(events: DataFrame, limit_ms: int = 1_800_000) -> DataFrame:
    """A stream of job events (EVENT) with whether each was accepted and the state that it met (JOB_OUT)."""
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStates(limit_ms), outputStructType=JOB_OUT, outputMode="append", timeMode="processingTime"
    )


def job_stream(spark: SparkSession, source: str, table: str, rejected: str, checkpoint: str, limit_ms: int = 1_800_000, available_now: bool = True, seconds: int = 5):
    """Job events (JSON lines of EVENT under source): accepted ones become the rows of a state table (job_id, status, error,
    created_at, started_at, finished_at), in which only the buckets of jobs that moved are written; others go to
    rejected/batch=<n>. A batch that runs again finds its rows in the table and sets them to the same values."""
    spark.conf.set(*STORE)
    moves = follow(spark.readStream.schema(EVENT).json(source), limit_ms)
    jobs_table = StateTable(spark, table, ["job_id"])

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        new = jobs.job_state(batch.where("accepted"), created=F.min(F.when(F.col("status") == "queued", F.col("ts"))))
        jobs_table.patch(new)
        batch.where("NOT accepted").write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        batch.unpersist()

    writer = moves.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return _started(spark, writer, available_now, seconds)
