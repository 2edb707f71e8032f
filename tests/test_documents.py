"""Documents by pages, and files out of tables: what does not decode, long documents, tasks that fail."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.operators import datasets, running, tiling
from sheetweave.plans import queries
from sheetweave.settings import Settings
from sheetweave.sources import documents
from tests.conftest import data


class Stub:
    """Documents of lines of text: a page of n for each line "n", one that does not decode for "bad"."""

    def count(self, body):
        if body == b"broken":
            raise ValueError("not a document")
        return len(body.split())

    def page(self, body, i, dpi):
        n = int(body.split()[i])
        return np.full((n, dpi, 3), i % 251, np.uint8)


@pytest.fixture
def drawings(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.PDF").write_text("2 3")
    (d / "sub/b.pdf").write_text("4 bad 5")
    (d / "c.pdf").write_text("broken")
    (d / "d.pdf").write_text("")
    (d / "note.txt").write_text("1")
    return d


def pages(spark, path, **options):
    spark.dataSource.register(documents.DrawingPages)
    reader = spark.read.format("drawing_pages").option("decoder", "tests.test_documents:Stub").option("dpi", "7")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(str(path))


def test_modes_fail_drop_and_report(spark, drawings):
    with pytest.raises(Exception, match="does not decode"):
        pages(spark, drawings).collect()
    name = lambda p: pathlib.PurePath(p).name
    got = pages(spark, drawings, mode="drop").collect()
    assert sorted((name(r.path), r.page, r.height, r.width, len(r.bgr)) for r in got) == [("a.PDF", 0, 2, 7, 42), ("a.PDF", 1, 3, 7, 63), ("b.pdf", 0, 4, 7, 84), ("b.pdf", 2, 5, 7, 105)]
    bad = pages(spark, drawings, mode="report").where("error IS NOT NULL").collect()
    assert sorted((name(r.path), r.page, r.bgr) for r in bad) == [("b.pdf", 1, None), ("c.pdf", None, None), ("d.pdf", None, None)] or {(name(r.path), r.page) for r in bad} == {("b.pdf", 1), ("c.pdf", None), ("d.pdf", None)}
    with pytest.raises(Exception, match="is none of"):
        pages(spark, drawings, mode="odd").collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        pages(spark, drawings / "no").collect()
    assert pages(spark, drawings, ending=".tif").count() == 0


def test_a_long_document_is_many_tasks(spark, tmp_path):
    (tmp_path / "long.pdf").write_text("1 " * 1000)
    got = pages(spark, tmp_path, max_pages=0, pages_per_task=25)
    assert got.rdd.getNumPartitions() == 40
    rows = got.select("page", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page for r in rows) == list(range(1000)) and len({r.task for r in rows}) == 40
    assert pages(spark, tmp_path).count() == 10  # the settings' most pages of a document


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_files_by_split(spark, tmp_path):
    rows = [("train", "labels/a.txt", b"one"), ("train", "b.bin", b""), ("valid", "labels/a.txt", b"two"), (None, "top.txt", b"3")]
    files = spark.createDataFrame(rows, "split string, name string, content binary").repartition(3)
    out = tmp_path / "out"
    documents.write_files(files, str(out))
    want = {"split=train/labels/a.txt": b"one", "split=train/b.bin": b"", "split=valid/labels/a.txt": b"two", "top.txt": b"3"}
    assert tree(out) == want and not (out / "_attempts").exists()
    documents.write_files(files.where("name = 'top.txt'").withColumn("content", F.lit(b"4")), f"file://{out}")
    assert tree(out) == want | {"top.txt": b"4"}
    documents.write_files(files.limit(0), str(out), "overwrite")
    assert tree(out) == {}
    with pytest.raises(Exception, match="not a name below"):
        documents.write_files(files.withColumn("name", F.lit("../x")), str(out))
    with pytest.raises(Exception, match="content are missing"):
        documents.write_files(files.drop("content"), str(out))


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    documents.write_files(spark.createDataFrame([("old.txt", b"old")], "name string, content binary"), str(out))
    bad = spark.range(0, 100, 1, 4).selectExpr("concat(id, '.txt') AS name", "CAST(CASE WHEN id = 77 THEN CAST(raise_error('lost') AS STRING) ELSE 'x' END AS BINARY) AS content")
    with pytest.raises(Exception, match="lost"):
        documents.write_files(bad, str(out), "overwrite")
    assert {k: v for k, v in tree(out).items() if not k.startswith("_attempts")} == {"old.txt": b"old"}
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(out)).count() == 1


def test_training_set_as_files(spark, tmp_path):
    """Label lines and crops of a small set: a file for each tile, lines as `%d %.6f ...`, crops as wide as their windows."""
    s = Settings()
    rows = [("I", "Tile_001", "object", 0, 10.0, 20.0, 100.0, 50.0, "pump"), ("I", "Tile_001", "object", 1, 0.0, 0.0, 1024.0, 512.0, "valve"), ("I", "Tile_001", "ocr", 0, 30.4, 40.0, 20.0, 10.0, "A1")]
    found = spark.createDataFrame(rows, "image_id string, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string")
    built = datasets.build(spark.createDataFrame([("I",)], "image_id string"), found, tiling.tile_grid(spark, s), ratio=0.0)
    name = built.tiles.first()["name"]
    rasters = spark.createDataFrame([(name, 1024, 1024, bytes(1024 * 1024 * 3))], "name string, th int, tw int, bgr binary")
    documents.write_files(documents.label_files(built).unionByName(documents.image_files(built, rasters)), str(tmp_path / "set"))
    (split,) = [r.split for r in built.tiles.select("split").distinct().collect()]
    got = tree(tmp_path / "set")
    line = lambda i, x, y, w, h: "%d %.6f %.6f %.6f %.6f" % (i, (x + w / 2) / 1024, (y + h / 2) / 1024, w / 1024, h / 1024)
    assert got[f"split={split}/labels/{name}.txt"].decode() == line(0, 10, 20, 100, 50) + "\n" + line(1, 0, 0, 1024, 512)
    (crop,) = [v for k, v in got.items() if "crops" in k]
    assert len(got) == 3 and got[f"split={split}/images/{name}.png"][:8] == b"\x89PNG\r\n\x1a\n"
    assert [int.from_bytes(crop[a : a + 4], "big") for a in (16, 20)] == [26, 16]


def test_a_class_is_no_task_of_its_own(spark):
    items = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0, 64.0, 64.0)], "label string, g0 double, g1 double, g2 double, g3 double, tw double, th double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for rows in (datasets.yolo_rows(items, datasets.class_index(items)), datasets.coco_rows(items, datasets.class_index(items))):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _training_set(spark):
    s = Settings(canvas_width=960, canvas_height=960, tile_size=512, tile_overlap=64)
    rng = random.Random(5)
    rows = []
    for i in range(23):
        for t in rng.sample(["Tile_001", "Tile_002", "Tile_004", "Tile_009"], rng.randrange(1, 4)):  # the grid has four
            for kind in ("object", "ocr", "arrow"):
                rows += [(f"I{i}", t, kind, n, 10.0, 20.0, 90.0, 20.0, rng.choice(["b", "a", None])) for n in rng.sample(range(30), rng.randrange(5))]
    rows += [(None, "Tile_001", "arrow", 0, 1.0, 2.0, 90.0, 2.0, "lost"), ("other", "Tile_001", "arrow", 0, 1.0, 2.0, 90.0, 2.0, "lost"), ("I0", "Tile_009", "arrow", 90, 1.0, 2.0, 90.0, 2.0, "off")]
    found = spark.createDataFrame(rows, "image_id string, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string")
    images = spark.createDataFrame([(f"I{i}",) for i in range(30)], "image_id string")  # 7 of them without annotation
    return rows, datasets.build(images, found, tiling.tile_grid(spark, s))


def test_categories_write_no_table_of_items(spark, monkeypatch):
    written = []
    monkeypatch.setattr(datasets, "kept", lambda df: written.append(df.columns) or df)
    _, built = _training_set(spark)
    assert [(r.id, r.name) for r in built.coco_categories.orderBy("id").collect()] == [(0, "annotation-lines"), (1, None), (2, "a"), (3, "b")]
    assert written and all(set(c) <= {"image_id", "kind", "label"} for c in written)


def test_categories_cut_arrows_once_and_send_no_images_whole(spark, monkeypatch):
    plans = []
    keep = datasets.kept
    monkeypatch.setattr(datasets, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = queries.dataset_categories(spark, data()).collect()
    assert sorted(map(tuple, rows)) == [
        (0, "annotation-lines", "none"), (1, "dimension_line", "annotation-lines"), (2, "leader_line", "annotation-lines")
    ]
    images, labels = sorted(plans, key=len)
    assert "Generate" not in images and labels.count("Scan parquet") == 2
    assert labels.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in labels  # the grid, and the images


def test_ids_are_counted_over_images(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(datasets, "running", lambda df, *a, **k: ran.append(df.columns) or running.running(df, *a, **k))
    rows, built = _training_set(spark)
    tiles = {}
    for r in sorted(built.tiles.collect(), key=lambda r: (r.image_id, r.tile_id)):
        tiles.setdefault(r.split, []).append(r)
    assert len(tiles) == 3 and {r.image_id for t in tiles.values() for r in t} <= {r[0] for r in rows} - {None, "other"}
    want, files = set(), {}
    for split, all_ in tiles.items():
        n = 0
        for place, t in enumerate(all_):
            files[split, place] = f"{t.name}.png"
            for r in sorted(r for r in rows if r[:3] == (t.image_id, t.tile_id, "arrow") and r[8]):
                want.add((split, n, place, "ab".index(r[8]) + 2))
                n += 1
    got = built.coco_annotations.collect()
    assert {(r.split, r.id, r.image_id, r.category_id) for r in got} == want and len(got) == len(want) > 20
    assert {(r.split, r.id): r.file_name for r in built.coco_images.collect()} == files
    assert all("item_idx" not in c and "tile_id" not in c for c in ran) and len(ran) == 1
