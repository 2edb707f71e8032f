"""Tables written once and read again: they cut lineage, survive lost executors and stay columnar."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task holds of a table that it writes or reads.
ROW_GROUP = 16 << 20
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where everything runs on one machine (tests)
    a temporary one stands in for it; a cluster without the setting is an error, as executors could not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='sheetweave-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for something that is deleted with the program, if not before."""
    path = f"{folder(spark)}/sheetweave-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append((spark, path))
    return path


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df as written to the shared folder, and its path."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    """df as written to the shared folder. It stays until remove() or the end of the program, as results are read lazily."""
    return kept_at(df)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete what kept_at() wrote and nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _WRITTEN[:] = [(s, p) for s, p in _WRITTEN if p != path]


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What is written inside is deleted at the end, but for the paths put on the list that is given out: for work whose
    result is a table, so that the steps towards it need not outlive it."""
    before, wanted = {p for _, p in _WRITTEN}, []
    yield wanted
    remove(spark, *[p for _, p in _WRITTEN if p not in before and p not in wanted])


def _remove_all() -> None:
    for spark, path in list(_WRITTEN):
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return
