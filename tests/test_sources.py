"""Files in and out, predictors, decisions of a language model, jobs, training sets and streams."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave import cli, workers
from sheetweave.operators import datasets, drift, merging, prediction, predictors
from sheetweave.operators.tiling import tile_grid
from sheetweave.plans import job
from sheetweave.settings import Settings
from sheetweave.sources import annotations, images, store
from sheetweave.streaming.detections import SCHEMA, log_stream, merge_stream

S = Settings(canvas_width=1100, canvas_height=1100, tile_size=600, tile_overlap=100)
SAMPLE = {
    "Image ID": "SHEET-9", "Tile ID": "Tile_003",
    "OBJECT/COMPONENT": [{"object_Bounding_Box": [12.5, 40.0, 33.0, 21.0], "classification_type": "valve", "confidence": 0.25}],
    "OCR": [{"content_bbox": [7.0, 8.0, 90.0, 18.0], "text_extracted": "⌀12 ±0.05"}],
    "Annotation Arrow": [{"Points": [3.0, 9.0, 64.0, 70.0], "class_id": "leader"}, {"Points": [80.0, 2.0, 10.0, 2.0], "class_id": "cut"}],
}


def test_annotations_round_trip(spark):
    for text in (json.dumps(SAMPLE), json.dumps([SAMPLE])):
        det = annotations.to_detections(annotations.parse(spark.createDataFrame([("f", text)], "path string, value string")))
        assert det.count() == 4
        back = annotations.to_annotations(det).first()
        assert json.loads(back.value) == SAMPLE


def test_three_numbers_are_rejected(spark):
    bad = {**SAMPLE, "OCR": [{"content_bbox": [4, 5, 6], "text_extracted": "x"}]}
    with pytest.raises(Exception, match="4 values"):
        annotations.to_detections(annotations.parse(spark.createDataFrame([("f", json.dumps(bad))], "path string, value string"))).collect()


def drawing():
    """A white sheet with a filled block, a long line across the middle seam and two words' worth of marks."""
    page = np.full((1100, 1100, 3), 255, np.uint8)
    page[200:320, 150:300] = 0
    page[700:702, 300:900] = 0
    for x in range(200, 290, 10):
        page[900:912, x : x + 6] = 0
    return page


def test_pages_are_read_and_endings_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PNG").write_bytes(images.encode_png(np.full((90, 40, 3), 200, np.uint8)))
    assert images.read_pages(spark, str(tmp_path / "in")).select("height", "width", "page").collect() == [(90, 40, 0)]
    (tmp_path / "in" / "b.pdf").write_bytes(b"3")
    with pytest.raises(ValueError, match="no decoder"):
        images.read_pages(spark, str(tmp_path / "in"))
    decode = {".pdf": lambda data, dpi, most: [np.full((dpi // 10, 20, 3), i, np.uint8) for i in range(int(data))]}
    got = images.read_pages(spark, str(tmp_path / "in"), decode, Settings(max_pages=2)).orderBy("path", "page").collect()
    assert [(r.path[-5:], r.page, r.height) for r in got] == [("a.PNG", 0, 90), ("b.pdf", 0, 30), ("b.pdf", 1, 30)]
    (tmp_path / "in" / "c.exe").write_bytes(b"0")
    with pytest.raises(ValueError, match="unsupported"):
        images.read_pages(spark, str(tmp_path / "in"), decode)


def test_enlarging_is_linear_between_pixels():
    s = Settings(canvas_width=8, canvas_height=4)
    out = images.to_canvas(np.array([[[0] * 3, [100] * 3]], np.uint8), s)
    assert out[0, :, 0].tolist() == [0, 0, 12, 38, 62, 88, 100, 100] and out.shape == (4, 8, 3)


def plain_components(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        todo, pixels = [(y, x)], []
        seen[y, x] = True
        while todo:
            r, c = todo.pop()
            pixels.append((r, c))
            for i in range(max(0, r - 1), min(mask.shape[0], r + 2)):
                for j in range(max(0, c - 1), min(mask.shape[1], c + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
        ys, xs = zip(*pixels)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(pixels)))
    return sorted(out)


def test_components_and_morphology_against_plain_search():
    rng = np.random.default_rng(31)
    for density in (0.1, 0.45, 0.8):
        mask = rng.random((37, 53)) < density
        assert sorted((x, y, w, h, int(own.sum())) for x, y, w, h, own in predictors.components(mask)) == plain_components(mask)
        wide = predictors.spread(mask, 3, 1)
        assert all(wide[y, x] == mask[y, max(0, x - 1) : x + 2].any() for y in range(37) for x in range(53))
        assert (predictors.shrink(mask, 3, 3) <= mask).all() and (predictors.spread(mask, 3, 3) >= mask).all()
    assert list(predictors.components(np.zeros((4, 4), bool))) == []


def test_ink_predictors():
    page = drawing()
    ((box, label, score),) = predictors.ShapeDetector()(page, 0.25)
    assert label == "component" and np.allclose(box, (150, 200, 150, 120), atol=1) and 0.85 < score <= 0.99
    ((line, label, score),) = predictors.StrokeDetector()(page, 0.3)
    assert label == "line_candidate" and abs(line[0] - 300) <= 1 and abs(line[2] - 899) <= 1 and 700 <= line[1] <= 701 and score == round(0.3 + 599 / np.hypot(1100, 1100), 3)
    read = []
    reader = predictors.RegionReader(lambda crops: [read.append(c.shape) or "A1" for c in crops], "test")
    ((box, text, prior),) = reader(page, 0.3)
    assert (text, prior) == ("A1", 0.9) and abs(box[0] - 196) <= 1 and len(read) == 1
    assert predictors.ShapeDetector()(np.full((50, 50, 3), 255, np.uint8), 0.1) == [] and predictors.NoReader()(page, 0.0) == []


def test_backends():
    def broken():
        raise OSError("no weights")

    assert prediction.choose("object", "auto", {"yolo": broken, "shapes": predictors.ShapeDetector}, "shapes").version == "shapes:1"
    with pytest.raises(OSError, match="no weights"):
        prediction.choose("object", "yolo", {"yolo": broken, "shapes": predictors.ShapeDetector}, "shapes")
    with pytest.raises(ValueError, match="no ocr backend"):
        prediction.choose("ocr", "other", {"none": predictors.NoReader}, "none")
    suite = prediction.default_suite(S, detectors={"trained": predictors.ShapeDetector})
    assert prediction.versions(suite.build()) == {"object": "shapes:1", "arrow": "strokes:1", "ocr": "none"} and "trained" in suite.version


def test_a_suite_is_built_once_for_each_worker(spark, tmp_path):
    page = images.encode_png(np.full((30, 30, 3), 255, np.uint8))
    for i in range(6):
        (tmp_path / f"{i}.png").write_bytes(page)
    tiles = images.tiles(images.read_pages(spark, str(tmp_path)), S).repartition(12)
    built = spark.sparkContext.accumulator(0)
    pids = lambda: [((0, 0, 1, 1), str(workers.once("pid", lambda: __import__("os").getpid())), 0.9)]

    def suite(name):
        def build():
            built.add(1)
            return {"object": lambda image, least: [((0, 0, 1, 1), name, 0.9), *pids()]}

        return prediction.Suite(name, "1", build)

    rows = prediction.infer(tiles, suite("one"), S).collect()
    processes = {r.label for r in rows if r.label != "one"}
    assert len(rows) == 48 and built.value <= len(processes) + 4 < 12
    # Another suite whose builder has the same name is another suite.
    assert {r.label for r in prediction.infer(tiles, suite("two"), S).collect()} - processes <= {"two", *map(str, range(10**6))}
    assert any(r.label == "two" for r in prediction.infer(tiles, suite("two"), S).collect())


def test_decisions():
    kinds = {"A:object:0": "object", "B:object:2": "object", "B:ocr:1": "ocr"}
    merges = [
        {"ids": ["A:object:0", "B:object:2", "A:object:0"], "label": "pump"}, {"ids": ["A:object:0", "B:ocr:1"]}, {"ids": ["A:object:0", "gone"]},
        {"ids": "A:object:0"}, 7
    ]
    reply = "```json\n" + json.dumps({
        "merges": merges, "relabels": [{"id": "B:ocr:1", "label": "M8"}, {"id": "gone", "label": "x"}, {"id": "B:ocr:1", "label": ""}]
    }) + "\n```"
    assert prediction.parse_decision(reply, kinds) == ([(["A:object:0", "B:object:2"], "pump")], {"B:ocr:1": "M8"})
    with pytest.raises(ValueError):
        prediction.parse_decision("[1]", kinds)


LINE = [(1, 0, "Tile_001", "arrow", 0, 220.0, 70.0, 600.0, 165.0, "cut", 0.9), (1, 0, "Tile_002", "arrow", 0, 0.0, 140.0, 440.0, 250.0, "pointer", 0.6)]


@pytest.fixture
def service():
    """A chat service that merges what geometry proposes; paths /fail and /slow do what they say."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body, self.headers.get("Authorization")))
            if self.path == "/fail":
                return self.send_error(500)
            if self.path == "/slow":
                threading.Event().wait(1.5)
            payload = json.loads(body["messages"][1]["content"])
            content = json.dumps({"merges": [{"ids": h, "label": "section"} for h in payload["hints"]]})
            out = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200)
            self.end_headers()
            try:
                self.wfile.write(out)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


@pytest.mark.parametrize(("path", "label", "failures"), [("/ok", "section", 0), ("/fail", "cut", 1), ("/slow", "cut", 1)])
def test_a_model_decides_and_failure_falls_back(spark, service, path, label, failures):
    url, asked = service
    s = Settings(
        canvas_width=1100, canvas_height=1100, tile_size=600, tile_overlap=100, merge_backend="llm", llm_url=url + path, llm_model="m", llm_key="k",
        llm_timeout=0.7
    )
    merged, report = prediction.merge_pages(spark.createDataFrame(LINE, SCHEMA), s)
    (r,) = merged.collect()
    assert r.label == label and [r.g0, r.g1, r.g2, r.g3] == [220, 70, 940, 250] and r.members == 2
    (n,) = report.collect()
    assert (n.pairs, n.merged_groups, n.llm_calls, n.llm_failures) == (1, 1, 1, failures)
    body, key = asked[0]
    payload = json.loads(body["messages"][1]["content"])
    assert body["temperature"] == 0 and body["model"] == "m" and key == "Bearer k" and body["messages"][0]["content"] == prediction.prompt("v1")
    assert payload["seam"] == [500.0, 0.0, 100.0, 600.0] and payload["orientation"] == "vertical" and len(payload["hints"]) == 1


def test_backend_needs_an_address(spark):
    det = spark.createDataFrame(LINE, SCHEMA)
    with pytest.raises(ValueError, match="LLM_URL"):
        prediction.merge_pages(det, Settings(merge_backend="llm"))
    with pytest.raises(ValueError, match="no merge backend"):
        prediction.merge_pages(det, Settings(merge_backend="other"))
    merged, report = prediction.merge_pages(det, S)
    assert merged.count() == 1 and report.select("llm_calls", "llm_failures").collect() == [(0, 0)]


def test_job_in_three_stages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sheet.png").write_bytes(images.encode_png(drawing()))
    at = str(tmp_path / "job")
    with pytest.raises(RuntimeError, match="run preprocess first"):
        job.infer(spark, at, S)
    job.preprocess(spark, str(tmp_path / "in"), at, S)
    with pytest.raises(RuntimeError, match="run infer first"):
        job.postprocess(spark, at, S)
    (r,) = job.run(spark, str(tmp_path / "in"), at, S).collect()
    assert r.image_id == "sheet" and r.drift.status == "no_baseline" and not r.drift.drift
    ((x, y, w, h), *_) = [o.geometry for o in r.merged["OBJECT/COMPONENT"]]
    assert abs(x - 150) <= 1 and abs(y - 200) <= 1 and abs(w - 150) <= 2 and r.counts["OBJECT/COMPONENT"] == 1
    (line,) = [a.geometry for a in r.merged["Annotation Arrow"]]
    assert abs(line[0] - 300) <= 1 and abs(line[2] - 899) <= 1 and len(r.tiles) >= 2
    (shown,) = spark.read.parquet(f"{at}/overlays").collect()
    (tmp_path / "shown").mkdir()
    (tmp_path / "shown" / "o.png").write_bytes(bytes(shown.png))
    (o,) = images.read_pages(spark, str(tmp_path / "shown")).collect()
    px = np.frombuffer(o.bgr, np.uint8).reshape(o.height, o.width, 3)
    assert px.shape == (1100, 1100, 3) and tuple(px[200, 220]) == images.COLOURS["object"] and tuple(px[701, 600]) == images.COLOURS["arrow"]
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "x.png").write_bytes(images.encode_png(np.full((40, 90, 3), 255, np.uint8)))
    (bare,) = job.run(spark, str(tmp_path / "blank"), f"{at}2", S).collect()
    assert bare.tiles == [] and bare.merged["OCR"] == [] and bare.counts["OCR"] == 0 and bare.merge_report.pairs == 0
    assert {t.stage for t in spark.read.parquet(f"{at}/timings").collect()} == {"preprocess", "infer", "postprocess"}
    spark.read.parquet(f"{at}/profiles").write.parquet(f"{tmp_path}/earlier")
    base = spark.read.parquet(f"{tmp_path}/earlier").selectExpr(
        "object_class_dist", "arrow_class_dist", "objects_per_tile * 100 AS objects_per_tile", "arrows_per_tile", "ocr_per_tile", "mean_confidence"
    )
    again = job.postprocess(spark, at, S, baseline=base)
    assert again.first().drift.flags == ["objects_per_tile_shift"] and job.drifted(again, "j").first() == ("j", True, 1)
    commands = [(c.kind, c.shape, c.g0, c.g1, c.g2, c.g3) for c in prediction.draw_commands(spark.read.parquet(f"{at}/merged")).collect()]
    shown = images.overlay(drawing(), commands, 550)
    assert shown.shape == (550, 550, 3) and (shown != drawing()[::2, ::2]).any()


def test_training_set_on_disk(spark, tmp_path):
    g = tile_grid(spark, S)
    rows = [("im1", "Tile_001", "object", 1, 0.0, 0.0, 60.0, 120.0, "b"), ("im1", "Tile_001", "object", 0, 300.0, 300.0, 150.0, 75.0, "a"), ("im2", "Tile_004", "arrow", 0, 2.0, 2.0, 50.0, 2.0, "leader"),
            ("im2", "Tile_004", "arrow", 1, 9.0, 9.0, 9.0, 80.0, "cut"), ("im3", "Tile_002", "ocr", 0, 1.0, 1.0, 40.0, 12.0, "R5")]
    found = spark.createDataFrame(rows, "image_id string, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string")
    images_ = spark.createDataFrame([("im1",), ("im2",), ("im3",), ("bare",)], "image_id string")
    built = datasets.build(images_, found, g, ratio=0.0)
    datasets.write(built, str(tmp_path))
    lines = {r.name: r.lines for r in spark.read.json(f"{tmp_path}/yolo").collect()}
    assert lines == {"im1_Tile_001": "0 0.625000 0.562500 0.250000 0.125000\n1 0.050000 0.100000 0.100000 0.200000", "im2_Tile_004": "", "im3_Tile_002": ""}
    coco = spark.read.json(f"{tmp_path}/coco_annotations").orderBy("id").collect()
    assert [(r.id, r.category_id, list(r.bbox)) for r in coco] == [(0, 2, [0.0, 0.0, 56.0, 8.0]), (1, 1, [5.0, 5.0, 8.0, 79.0])]
    assert [r["name"] for r in spark.read.json(f"{tmp_path}/coco_categories").orderBy("id").collect()] == ["annotation-lines", "cut", "leader"]
    (crop,) = spark.read.json(f"{tmp_path}/ocr").collect()
    assert (crop.crop, crop.text, crop.tile) == ("ocr/crops/im3_Tile_002_0.png", "R5", "im3_Tile_002")
    assert spark.read.text(f"{tmp_path}/yolo_data", wholetext=True).first()[0].rstrip("\n").endswith("names:\n  0: a\n  1: b")
    splits = {r.split for r in spark.read.json(f"{tmp_path}/tiles").collect()}
    back = datasets.read_annotations(spark, str(tmp_path))
    assert back.count() == 5 and sum(datasets.read_annotations(spark, str(tmp_path), s).count() for s in splits) == 5
    (m,) = built.manifest.collect()
    assert (m.object_class_counts, m.arrow_classes, m.items) == ({"a": 1, "b": 1}, ["cut", "leader"], 5)
    cli.main(["baseline", str(tmp_path), f"{tmp_path}/base"], spark)
    (b,) = drift.latest_baseline(spark.read.parquet(f"{tmp_path}/base")).collect()
    assert b["name"] == "default" and b.profile.n_tiles >= 1


def test_synthetic_drawings_of_one_small_file_are_drawn_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from sheetweave.sources import synthetic

    seeds = spark.range(0, 40, 1, 1).selectExpr("id AS drawing", "7 AS seed")
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(synthetic.placed(seeds)) == 4 and parts(synthetic.drawings(seeds)) == 4


def test_synthetic_parts_are_drawn_once(spark):
    from sheetweave.sources import synthetic

    drawn = synthetic.drawings(spark.range(0, 4, 1, 1).withColumnRenamed("id", "drawing"))
    assert str(drawn._jdf.queryExecution().optimizedPlan()).count("aggregate(") == 2  # components, and tries within


def test_synthetic_pages_hold_what_their_truth_says(spark):
    from sheetweave.sources import synthetic

    drawn = synthetic.drawings(spark.range(2).withColumnRenamed("id", "drawing"))
    (page, *_) = synthetic.pages(drawn).orderBy("path").collect()
    px = np.frombuffer(page.bgr, np.uint8).reshape(page.height, page.width, 3)[:, :, 0]
    items = drawn.where("drawing = 0").collect()
    assert (page.height, page.width) == (synthetic.HEIGHT, synthetic.WIDTH) and len(items) % 3 == 0
    for r in items:
        x, y = (r.g0 + r.g2 / 2, r.g1) if r.kind == "object" else ((r.g0 + r.g2) / 2, (r.g1 + r.g3) / 2) if r.kind == "arrow" else (r.g0 + 4, r.g1 + 14)
        assert px[int(y) - 1 : int(y) + 2, int(x) - 1 : int(x) + 2].min() == 0
    assert 0.001 < (px == 0).mean() < 0.1


def test_cli(spark, tmp_path):
    cli.main(["synthetic", f"{tmp_path}/s", "--n", "3"], spark)
    assert spark.read.parquet(f"{tmp_path}/s").select("drawing").distinct().count() == 3
    cli.main(["prompts", f"{tmp_path}/p"], spark)
    assert [r.version for r in spark.read.parquet(f"{tmp_path}/p").collect()] == ["v1"]


def test_store(spark, tmp_path):
    at = f"{tmp_path}/files"
    schema = "file_id string, name string, content binary, content_type string, job_id string, kind string"
    store.put(spark.createDataFrame([("f1", "a.png", b"one", "image/png", "j", "canvas")], schema), at)
    store.put(spark.createDataFrame([("f1", "a.png", b"newer", "image/png", "j", "canvas"), ("f2", "b", b"", "x", "j", "k")], schema), at)
    assert store.get(spark, at, "f1").first().content == b"newer" and store.get(spark, at, "no").count() == 0
    assert "content" not in store.info(spark, at).columns and sorted(r.length for r in store.info(spark, at).collect()) == [0, 3, 5]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(p, 0, t, "object", 0, *map(float, g), "valve", 0.9) for p in (1, 2) for t, g in (("Tile_001", (530, 410, 52, 36)), ("Tile_002", (31, 409, 52, 37)))]
    det = spark.createDataFrame(rows, SCHEMA)
    det.coalesce(1).write.parquet(f"{tmp_path}/in")
    merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", S).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = merging.merge(det, S)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    logs = [
        '{"ts": "2024-05-01T10:00:00", "path": "/v1/jobs", "status_code": 200, "latency_ms": 12.3456}',
        '{"ts": "2024-05-01T10:00:01", "path": "/healthz", "status_code": 200, "latency_ms": 1}', "no json"
    ]
    spark.createDataFrame([(x,) for x in logs], "value string").coalesce(1).write.text(f"{tmp_path}/logs")
    log_stream(spark, f"{tmp_path}/logs", f"{tmp_path}/log", f"{tmp_path}/log_check").awaitTermination()
    assert [(r.path, r.latency_ms) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [("/v1/jobs", 12.35)]


def test_lines_of_text_from_letters():
    """Letters side by side are one line; a second line, a far letter, long rules and solid shapes are not part of it."""
    page = np.full((300, 600, 3), 255, np.uint8)

    def letter(x, y):
        page[y : y + 16, x : x + 3] = page[y : y + 3, x : x + 10] = 0

    for k in range(6):
        letter(100 + 16 * k, 50)
    for k in range(3):
        letter(100 + 16 * k, 80)
    letter(400, 50)
    page[120:123, 20:580] = 0
    page[150:190, 50:130] = 0
    assert sorted(predictors.text_regions(page)) == [(96, 49, 98, 18), (96, 79, 50, 18), (396, 49, 18, 18)]
    assert predictors.text_regions(np.full((40, 40, 3), 255, np.uint8)) == []
