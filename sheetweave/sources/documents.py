"""Documents read page by page, and files written out of a table, as data sources for Spark.

    spark.dataSource.register(DrawingPages); spark.dataSource.register(FileTree)
    spark.read.format("drawing_pages").option("decoder", "module:name").load("/drawings")
    files.write.format("file_tree").mode("append").save("/training")
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sheetweave.operators.datasets import TrainingSet
from sheetweave.sources.images import encode_png

PAGES = "path string, page int, height int, width int, bgr binary, error string"
MODES = ("fail", "drop", "report")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:///"):
        path = path[len("file://") :]
    return fs.FileSystem.from_uri(path)


def _named(spec: str) -> Any:
    """The decoder that "module:name" names: count(bytes) -> pages, page(bytes, number, dpi) -> BGR image."""
    module, _, name = spec.partition(":")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found() if isinstance(found, type) else found


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    end: int
    error: str | None = None


class DrawingPages(DataSource):
    """Pages of documents: a task reads some pages of one file, so a long document is many tasks and a bad one is a row.

    Options: path (a file or a folder), decoder (module:name), ending (.pdf), dpi (300), max_pages (10; 0 for all),
    pages_per_task (8), mode. What does not decode, a document or a page, fails the job (mode fail, the default), is
    left out (drop), or is a row with error and without pixels (report). Documents without pages count as not decoded.
    Planning opens every document once to count its pages, several at a time."""

    @classmethod
    def name(cls) -> str:
        return "drawing_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder = options["path"], options["decoder"]
        self.ending, self.mode = options.get("ending", ".pdf").lower(), options.get("mode", "fail")
        self.dpi, self.most, self.step = (int(options.get(k, d)) for k, d in (("dpi", 300), ("max_pages", 10), ("pages_per_task", 8)))
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {', '.join(MODES)}")

    def partitions(self) -> list[PageRange]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info.path] if info.type == fs.FileType.File else sorted(
            f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(self.ending)
        )
        decoder = _named(self.decoder)

        def ranges(path: str) -> list[PageRange]:
            try:
                n = decoder.count(self._bytes(store, path))
                if n < 1:
                    raise ValueError("no pages")
            except Exception as x:
                if self.mode == "fail":
                    raise ValueError(f"does not decode: {path}: {x}") from x
                return [] if self.mode == "drop" else [PageRange(path, 0, 0, f"{type(x).__name__}: {x}")]
            n = min(n, self.most) if self.most else n
            return [PageRange(path, lo, min(lo + self.step, n)) for lo in range(0, n, self.step)]

        with ThreadPoolExecutor(16) as pool:
            found = [r for part in pool.map(ranges, files) for r in part]
        return found or [PageRange("", 0, 0)]  # Spark asks for a partition even of nothing

    @staticmethod
    def _bytes(store: fs.FileSystem, path: str) -> bytes:
        with store.open_input_file(path) as f:
            return f.read()

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, None, None, None, None, partition.error
        if partition.first == partition.end:
            return
        body, decoder = self._bytes(_store(self.path)[0], partition.path), _named(self.decoder)
        for i in range(partition.first, partition.end):
            try:
                image = decoder.page(body, i, self.dpi)
                yield partition.path, i, image.shape[0], image.shape[1], image.tobytes(), None
            except Exception as x:
                if self.mode == "fail":
                    raise ValueError(f"does not decode: {partition.path}, page {i}: {x}") from x
                if self.mode == "report":
                    yield partition.path, i, None, None, None, f"{type(x).__name__}: {x}"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class FileTree(DataSource):
    """A file for each row (name, content, and any of split): content below path as name, or as split=<split>/name.

    Files appear when the whole job has ended: tasks write to folders of their own, and the commit moves what the tasks
    that count have written and removes the rest, so a task that fails, or is tried twice, leaves nothing; what a task was
    writing when its job was given up may stay below _attempts, which readers skip. Mode overwrite
    empties path first, append adds and replaces files of equal names. Names may hold folders but not lead out of path."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {', '.join(sorted(missing))} are missing")
        return FileTreeWriter(self.options["path"], overwrite)


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        _store(self.path)[0].create_dir(self._attempts(), recursive=True)

    def _attempts(self) -> str:
        return f"{_store(self.path)[1]}/_attempts/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _store(self.path)
        attempt, names = f"{self._attempts()}/{uuid.uuid4().hex}", []
        store.create_dir(attempt, recursive=False)
        for batch in iterator:
            if store.get_file_info(attempt).type != fs.FileType.Directory:
                raise RuntimeError("the job was given up")  # and its folder removed: this task is to write no more
            splits = batch.column("split") if "split" in batch.schema.names else [None] * batch.num_rows
            for name, content, split in zip(batch.column("name"), batch.column("content"), splits):
                split = split.as_py() if split is not None else None
                if ".." in name.as_py().split("/") or name.as_py().startswith("/"):
                    raise ValueError(f"not a name below the folder: {name.as_py()}")
                to = name.as_py() if split is None else f"split={split}/{name.as_py()}"
                at = f"{attempt}/{to}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content.as_buffer())
                names.append(to)
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.base_name != "_attempts":
                    store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        moves = [(f"{m.attempt}/{n}", f"{at}/{n}") for m in messages if m for n in m.names]
        for folder in {to.rpartition("/")[0] for _, to in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(_store(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self._attempts()).type == fs.FileType.Directory:
            store.delete_dir(self._attempts())
        above = self._attempts().rpartition("/")[0]
        if not store.get_file_info(fs.FileSelector(above, allow_not_found=True)) and store.get_file_info(above).type == fs.FileType.Directory:
            store.delete_dir(above)


def label_files(built: TrainingSet) -> DataFrame:
    """(split, name, content): labels/<tile>.txt of every tile of a training set."""
    return built.yolo.select("split", F.concat(F.lit("labels/"), "name", F.lit(".txt")).alias("name"), F.col("lines").cast("binary").alias("content"))


def image_files(built: TrainingSet, rasters: DataFrame) -> DataFrame:
    """(split, name, content): images/<tile>.png of every tile and every text crop, out of rasters (name, th, tw, bgr)."""
    import numpy as np

    crops = built.ocr.select(F.col("tile").alias("name"), F.struct(F.col("crop").alias("to"), "x0", "y0", "x1", "y1").alias("c"))
    per = crops.groupBy("name").agg(F.collect_list("c").alias("crops"))  # a tile's texts
    rows = built.tiles.select("split", "name").join(rasters.select("name", "th", "tw", "bgr"), "name").join(per, "name", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                image = np.frombuffer(r["bgr"], np.uint8).reshape(r["th"], r["tw"], 3)
                out = [(f"images/{r['name']}.png", encode_png(image))]
                out += [(c["to"], encode_png(image[c["y0"] : c["y1"], c["x0"] : c["x1"]])) for c in r["crops"] or ()]
                names, contents = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([r["split"]] * len(out)), pa.array(names), pa.array(contents, pa.binary())], ["split", "name", "content"])

    return rows.select("split", "name", "th", "tw", "bgr", "crops").mapInArrow(cut, "split string, name string, content binary")


def write_files(files: DataFrame, out: str, mode: str = "append") -> None:
    """Rows (name, content, and any of split) as files below out."""
    files.sparkSession.dataSource.register(FileTree)
    files.write.format("file_tree").mode(mode).save(out)
