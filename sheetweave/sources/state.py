"""Tables of state that are rewritten in part: rows in buckets by the hash of their key, and versions named by a manifest.

A write touches the buckets of its rows only: it puts their new files into a folder of its own and then adds a manifest
that names the folder of every bucket (several where rows were put in beside others). The manifest is created under a number that no other has, in one step, as the last
thing; until then readers see the version before, and a writer that dies leaves nothing that is read. Two writers that
start from one version cannot both end: the second finds the number taken and raises. Nothing of a table passes through
the driver but the names of buckets, whose number is fixed when the table is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetweave.operators import jobs

BUCKETS = 64
#: Folders of a bucket from which on rows put in beside others rewrite it into one.
FOLDERS = 64
_B = "bucket_"


def _listed(folders: str | list[str]) -> list[str]:
    return [folders] if isinstance(folders, str) else folders


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class StateTable:
    """Rows by key under `path`, in any store that Spark writes to; `buckets` counts when the table is first written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), keys, buckets

    # --- versions

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, schema, folders: {bucket: folder, or a list of them}} of a version, the last if none is named; of no table
        an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self._buckets, "schema": None, "folders": {}}
        fs, at = self._fs(f"{self.path}/_versions/{version or known[-1]:09d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Written beside and then renamed: the number is there with all its text, or not at all, and never twice."""
        fs, at = self._fs(f"{self.path}/_versions/{manifest['version']:09d}.json")
        beside = self._fs(f"{self.path}/_versions/.{uuid.uuid4().hex}")[1]
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(beside, at):
            fs.delete(beside, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    # --- reading

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(n)).cast("int")

    def _rows(self, manifest: dict, of: list[int] | None = None) -> DataFrame | None:
        if not manifest["schema"]:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{f}/{_B}={b}" for b, fs in manifest["folders"].items() if of is None or int(b) in of for f in _listed(fs)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the last version, or of one that is still there."""
        rows = self._rows(self.manifest(version))
        if rows is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return rows

    def get(self, **key) -> DataFrame:
        """The row of one key. Only its bucket is read, and the filter reaches the scan."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        one = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], T.StructType([schema[k] for k in self.keys]))
        bucket = one.select(self._bucket(manifest["buckets"])).first()[0]
        rows = self._rows(manifest, [bucket])
        for k in self.keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k]).cast(schema[k].dataType)))
        return rows

    # --- writing

    def _change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """A version in which the buckets of rows hold change(what they held, rows)."""
        manifest = self.manifest()
        n, folder = manifest["buckets"], f"data/{uuid.uuid4().hex}"
        touched = [r[0] for r in rows.select(self._bucket(n)).distinct().collect()]  # n numbers at most
        if not touched:
            return manifest["version"]
        held = self._rows(manifest, touched)
        new = change(held, rows) if held is not None else rows
        new.withColumn(_B, self._bucket(n)).repartition(min(n, len(touched)), _B).write.partitionBy(_B).parquet(f"{self.path}/{folder}")
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {str(b): folder for b in self._there(folder, touched)}
        version = manifest["version"] + 1
        self._publish({"version": version, "buckets": n, "schema": new.schema.jsonValue(), "folders": folders})
        return version

    def _there(self, folder: str, buckets) -> list[int]:
        fs, _ = self._fs(self.path)
        return [b for b in buckets if fs.exists(self._fs(f"{self.path}/{folder}/{_B}={b}")[1])]

    def append(self, rows: DataFrame) -> int:
        """Rows put in beside those that are there, which are neither read nor written again; the version made. They have the table's
        columns, and their keys must be new to it and differ. A bucket that lies in FOLDERS folders is rewritten into one."""
        manifest = self.manifest()
        if any(len(_listed(f)) >= FOLDERS for f in manifest["folders"].values()):
            return self.upsert(rows)
        n, folder = manifest["buckets"], f"data/{uuid.uuid4().hex}"
        if manifest["schema"]:
            rows = rows.select(*T.StructType.fromJson(manifest["schema"]).fieldNames())
        # Parts as large as Spark likes them, so that a bucket of many rows is no single task.
        rows.withColumn(_B, self._bucket(n)).hint("rebalance", _B).write.partitionBy(_B).parquet(f"{self.path}/{folder}")
        there = self._there(folder, range(n))
        if not there:
            return manifest["version"]
        folders = manifest["folders"] | {str(b): [*_listed(manifest["folders"].get(str(b), [])), folder] for b in there}
        version = manifest["version"] + 1
        self._publish({"version": version, "buckets": n, "schema": manifest["schema"] or rows.schema.jsonValue(), "folders": folders})
        return version

    def upsert(self, rows: DataFrame) -> int:
        """Rows put in, replacing those of equal keys; the version made. Of rows of one key in `rows` all would stay, so keys there must differ."""
        return self._change(rows, lambda held, new: jobs.upsert(held, new, self.keys))

    def patch(self, rows: DataFrame) -> int:
        """The columns of rows set where keys match; a null leaves what was there; new keys are added. The version made."""
        return self._change(rows, lambda held, new: jobs.patch(held, new, self.keys))

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys taken out; the version made."""
        if not self.versions():
            return 0
        return self._change(keys, lambda held, gone: held.join(gone.select(*self.keys), self.keys, "left_anti"))

    def vacuum(self, versions: int = 2) -> None:
        """Delete manifests but the last ones, and folders that none of these names. For times when nobody writes: a folder
        that is being written is named by no manifest yet."""
        known = self.versions()
        fs, _ = self._fs(self.path)
        named = {f for v in known[-versions:] for fs_ in self.manifest(v)["folders"].values() for f in _listed(fs_)}
        for v in known[:-versions]:
            fs.delete(self._fs(f"{self.path}/_versions/{v:09d}.json")[1], False)
        at = self._fs(f"{self.path}/data")[1]
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if f"data/{f.getPath().getName()}" not in named:
                fs.delete(f.getPath(), True)
