"""The registered queries of the drawing operators, each over its whole input."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.functions import text as T
from sheetweave.operators import datasets, decisions, drift, evaluation, jobs, layouts, lines, merging, prediction, results, tiling
from sheetweave.plans import fixtures
from sheetweave.scratch import kept, new_path, remove
from sheetweave.settings import Settings
from sheetweave.sources import store, synthetic
from sheetweave.sources.state import StateTable
from sheetweave.streaming import detections as detections_stream

S = Settings()


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cands(spark: SparkSession, d: str, kind: str, page: str = fixtures.PAGE) -> DataFrame:
    """Written once: pairs, edges and members are all taken from them."""
    found = fixtures.detections(spark, d, S, kind, page)
    return kept(merging.candidates(merging.apply_thresholds(found, S), S))


def _edges(cands: DataFrame, kind: str, crowded: bool = False) -> DataFrame:
    return merging.match_edges(merging.seam_candidates(cands, S), S, kinds=(kind,), crowded=crowded)


def _near(spark: SparkSession, d: str, kind: str) -> DataFrame:
    found = fixtures.detections(spark, d, S, kind)
    return merging.seam_candidates(merging.candidates(merging.apply_thresholds(found, S), S), S)


def _members(spark: SparkSession, d: str, kind: str) -> DataFrame:
    cands = _cands(spark, d, kind)
    return merging.grouped(cands, merging.components(_edges(cands, kind)))


def _sheets(spark, d) -> DataFrame:
    """A sheet of its own size for each part, from smaller than a tile to a large drawing."""
    return _read(spark, d, "part").selectExpr("p_partkey AS page", "CAST(300 + p_size * 97 AS INT) AS width", "CAST(200 + (p_partkey % 90) * 53 AS INT) AS height")


def tile_starts(spark, d):
    starts = tiling.starts_column(F.col("width"), F.lit(S.tile_size), F.lit(S.tile_overlap))
    return _sheets(spark, d).select("page", "width", F.array_join(starts.cast("array<string>"), ",").alias("starts"))


def tile_grid(spark, d):
    return tiling.page_grid(_sheets(spark, d), S)


def tile_pairs(spark, d):
    return layouts.pairs(tiling.page_grid(_sheets(spark, d), S), S.seam_margin)


def canvas_fit(spark, d):
    pages = _read(spark, d, "part").selectExpr("p_partkey AS page", "p_size * 97 AS orig_w", "CAST((p_partkey % 90 + 1) * 53 AS INT) AS orig_h")
    return tiling.canvas_fit(pages, S).select("page", "rotated", "scale", "new_w", "new_h", "pad_x", "pad_y")


def coords_round_trip(spark, d):
    pages = _read(spark, d, "part").selectExpr(
        "p_partkey AS page", "p_size * 97 AS orig_w", "CAST((p_partkey % 90 + 1) * 53 AS INT) AS orig_h", "CAST(p_size AS DOUBLE) AS x",
        "CAST(p_partkey % 31 AS DOUBLE) AS y"
    )
    fit = tiling.canvas_fit(pages, S)
    t = {c: F.col(c) for c in ("rotated", "scale", "pad_x", "pad_y", "orig_h")}
    x, y = G.to_original(*G.to_canvas(F.col("x"), F.col("y"), t), t)
    return fit.select("page", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def box_iou_pairs(spark, d):
    a = fixtures.truth(spark, d, "object")
    b = a.select("page", F.col("id").alias("b"), *[F.col(f"g{i}").alias(f"h{i}") for i in range(4)])
    out = a.select("page", F.col("id").alias("a"), "g0", "g1", "g2", "g3").join(b, "page").where(F.col("a") < F.col("b"))
    return out.select("a", "b", G.iou(G.quad("g"), G.quad("h")).alias("iou")).where("iou > 0")


def segment_box_codec(spark, d):
    t = fixtures.truth(spark, d, "arrow")
    box = G.segment_to_box(G.quad("g"))
    back = G.box_to_segment(box)
    form = F.when(box[2] >= 3 * box[3], "level").when(box[3] >= 3 * box[2], "upright").otherwise("diagonal")
    return t.select("id", form.alias("form"), *[v.alias(f"s{i}") for i, v in enumerate(back)])


def _slices(kind, digits=None):
    def run(spark, d):
        g = [F.round(f"g{i}", digits).alias(f"g{i}") if digits else F.col(f"g{i}") for i in range(4)]
        return fixtures.detections(spark, d, S, kind).select("page", "id", "tile_id", F.col("item_idx").cast("long").alias("item_idx"), *g, "label")
    return run


def apply_thresholds(spark, d):
    return merging.apply_thresholds(fixtures.detections(spark, d, S), S).groupBy("kind").agg(F.count("*").alias("n"))


def seam_candidates(spark, d):
    return _near(spark, d, "object").groupBy("pair_ord", "side").agg(F.count("*").alias("n"))


def active_pairs(spark, d):
    return merging.active_pairs(_near(spark, d, "object"))


def _matches(kind, page=fixtures.PAGE):
    return lambda spark, d: _edges(_cands(spark, d, kind, page), kind, page == fixtures.DENSE).select("page", "pair_ord", "src", "dst")


def components(spark, d):
    return merging.components(_edges(_cands(spark, d, "object"), "object"))


def _out(df: DataFrame, digits: int | None = None) -> DataFrame:
    g = [F.round(f"g{i}", digits).alias(f"g{i}") if digits else F.col(f"g{i}") for i in range(4)]
    return df.select("page", "root", *g, "label", "confidence", F.array_join("source_tiles", ",").alias("source_tiles"), "members")


def merge_objects(spark, d):
    return _out(merging.fuse_objects(_members(spark, d, "object")))


def merge_arrows(spark, d):
    return _out(merging.fuse_arrows(_members(spark, d, "arrow")), 6)


def merge_text(spark, d):
    return _out(merging.fuse_texts(_members(spark, d, "ocr")))


def text_groups(spark, d):
    return merge_text(spark, d).select("page", "root", "g0", "g1", "g2", "g3", "confidence", "members")


def merged_pages(spark, d):
    """All kinds of all pages, in page order, one row per item."""
    det = merging.apply_thresholds(fixtures.detections(spark, d, S), S)
    g = [F.round(f"g{i}", 6).alias(f"g{i}") for i in range(4)]
    return merging.in_order(merging.merge(det, S)).select("page", "kind", F.col("place").cast("long").alias("place"), *g, "label", "confidence", "members")


def class_vote(spark, d):
    return merging.vote(_members(spark, d, "object"), ["page", "root"])


def merge_report(spark, d):
    cands = _cands(spark, d, "object")
    near = merging.seam_candidates(cands, S)
    members = merging.grouped(cands, merging.components(merging.match_edges(near, S, kinds=("object",))))
    return merging.report(merging.fuse_objects(members), near)


def page_counts(spark, d):
    k = fixtures.detections(spark, d, S).groupBy("page")
    return k.agg(*[F.count_if(F.col("kind") == a).alias(b) for a, b in (("object", "objects"), ("ocr", "ocr"), ("arrow", "arrows"))])


def _profiles(spark, d) -> DataFrame:
    e = _read(spark, d, "events").selectExpr(
        "user_id % 10 AS job", "CAST(ts AS DATE) AS day", "'object' AS kind", "event_type AS label",
        "CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS confidence", "hour(ts) AS hr"
    )
    return drift.profile(e, e.groupBy("job", "day").agg(F.countDistinct("hr").alias("n_tiles")), by=("job", "day"))


def drift_profile(spark, d):
    p = _profiles(spark, d)
    return p.select(
        "job", "day", "n_tiles", F.explode("object_class_dist").alias("label", "share"), F.round("objects_per_tile", 9).alias("objects_per_tile"),
        F.round("mean_confidence", 9).alias("mean_confidence")
    ).withColumn("share", F.round("share", 9))


def average_profile(spark, d):
    a = drift.average(_profiles(spark, d), by=("job",))
    return a.select(
        "job", "n_tiles", F.explode("object_class_dist").alias("label", "share"), F.round("objects_per_tile", 9).alias("objects_per_tile")
    ).withColumn("share", F.round("share", 9))


def drift_compare(spark, d):
    p = _profiles(spark, d)
    cols = [*drift.DISTS, *drift.RATES, "mean_confidence"]
    base = drift.average(p, by=("job",)).where("job % 4 <> 3").select("job", F.struct(*cols).alias("baseline"))  # some jobs have none
    out = drift.compare(p.select("job", "day", F.struct(*cols).alias("current")).join(base, "job", "left"), S)
    rounded = [F.round(c, 7).alias(c) for c in ("object_class_psi", "arrow_class_psi", *[f"{r}_shift" for r in drift.RATES], "confidence_drop")]
    return out.select("job", "day", *rounded, "drift", "status", F.array_join("flags", ",").alias("flags"))


def rolling_baseline(spark, d):
    p = drift.rolling(_profiles(spark, d), S, ["objects_per_tile"], part="job", order="day")
    return p.select("job", "day", F.round("base_objects_per_tile", 9).alias("base"))


def recent_profiles(spark, d):
    p = _profiles(spark, d).withColumn("created_at", F.struct("day", (-F.col("job")).alias("j")))
    return drift.recent(p, 50).select("job", "day", "n_tiles")


def latest_baseline(spark, d):
    e = _read(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.col("ts").alias("created_at")).agg(F.max("value").alias("profile"))
    return drift.latest_baseline(e)


def split_assignment(spark, d):
    return datasets.assign_splits(_read(spark, d, "part").select(F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("image_id")))


def class_index(spark, d):
    labels = _read(spark, d, "part").select(F.col("p_type").alias("label"))
    return datasets.class_index(labels).select("label", F.col("idx").cast("int").alias("yolo"), (F.col("idx") + 1).cast("int").alias("coco"))


def _tiles(df: DataFrame) -> DataFrame:
    return df.withColumns({"tw": F.lit(float(S.tile_size)), "th": F.lit(float(S.tile_size)), "item_idx": F.col("item_idx").cast("long")})


def yolo_labels(spark, d):
    o = kept(_tiles(fixtures.detections(spark, d, S, "object")))
    return datasets.yolo_rows(o, datasets.class_index(o)).select("page", "tile_id", "item_idx", F.col("idx").cast("int").alias("idx"), "cx", "cy", "rw", "rh")


def coco_annotations(spark, d):
    a = kept(_tiles(fixtures.detections(spark, d, S, "arrow")))
    rows = datasets.coco_rows(a, datasets.class_index(a, first=1)).withColumn("split", F.expr("element_at(array('train', 'valid', 'test'), CAST(page % 3 AS INT) + 1)"))
    rows = datasets.number_within(rows, "split", ["page", "tile_id", "item_idx"], "n")
    return rows.select(
        "split", F.col("n").cast("long").alias("id"), "page", "tile_id", "item_idx", F.col("idx").cast("int").alias("category_id"),
        *[F.round(c, 6).alias(c) for c in "xywh"]
    )


def ocr_crops(spark, d):
    return datasets.ocr_crops(_tiles(fixtures.detections(spark, d, S, "ocr"))).select("page", "tile_id", "item_idx", "x0", "y0", "x1", "y1")


def manifest(spark, d):
    m = datasets.manifest(fixtures.detections(spark, d, S))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    lists = [F.array_join(c, ",").alias(c) for c in ("object_classes", "arrow_classes")]
    return m.select(*lists, text("object_class_counts"), text("arrow_class_counts"), "objects", "texts", "arrows", "items")


def ocr_cer(spark, d):
    p = _read(spark, d, "part").selectExpr("p_name AS truth", "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_type, 'A', 'E') END AS read")
    return evaluation.character_errors(p).select(F.round("cer", 9).alias("cer"), F.round("exact", 9).alias("exact"), "n")


def champion_promotion(spark, d):
    return evaluation.promotions(_read(spark, d, "customer").selectExpr("c_nationkey AS model", "c_custkey AS version", "c_acctbal AS metric"))


def word_lines(spark, d):
    w = _read(spark, d, "events").selectExpr(
        "event_id % 40 AS page", "0 AS block", "event_id % 3 AS par", "event_id % 11 AS line", "(event_id * 37) % 2000 AS left",
        "(event_id * 13) % 9 AS top", "20 + event_id % 50 AS width", "12 AS height", "event_id % 101 - 1 AS conf", "event_type AS text"
    )
    return evaluation.word_lines(w).select("page", "par", "line", "x", "y", "w", "h", "text", F.round("confidence", 9).alias("confidence"))


def hough_topk(spark, d):
    e = _read(spark, d, "events").selectExpr("event_id % 7 AS tile", "event_id AS ord", "CAST((event_id * 7919) % 1400 AS DOUBLE) AS len", "1448.0D AS diag")
    return evaluation.longest_lines(e, by=("tile",)).select("tile", "ord", F.round("score", 9).alias("score"))


def contour_gate(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id AS id", "CAST(10 + event_id % 700 AS DOUBLE) AS w", "CAST(10 + (event_id * 7) % 700 AS DOUBLE) AS h", "event_id", "1024.0D AS tw",
        "1024.0D AS th"
    )
    e = e.withColumn("area", F.col("w") * F.col("h") * ((F.col("event_id") % 100) / F.lit(100.0)))
    return evaluation.contour_gate(e).select("id", F.round("score", 9).alias("score"))


def text_gate(spark, d):
    return evaluation.text_gate(_read(spark, d, "events").selectExpr(
        "event_id AS id", "event_id % 400 AS w", "event_id % 110 AS h", "(event_id % 100) / 100.0D AS density"
    )).select("id")


def recent_jobs(spark, d):
    j = _read(spark, d, "orders").selectExpr(
        "o_orderkey AS job_id", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END AS status",
        "o_orderdate AS created_at"
    )
    return jobs.recent_jobs(j, "succeeded")


def job_state(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id % 500 AS job_id", "ts", "element_at(array('queued', 'running', 'succeeded', 'failed'), CAST(event_id % 4 AS INT) + 1) AS status",
        "CAST(null AS STRING) AS error"
    )
    return jobs.job_state(e).select("job_id", "status", "created_at")


def request_log_summary(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "CASE event_id % 5 WHEN 0 THEN '/healthz' ELSE concat('/v1/', event_type) END AS path",
        "CASE WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status_code", "value AS latency_ms"
    )
    return jobs.request_summary(e).withColumn("mean_ms", F.round("mean_ms", 6))


def feedback_valid(spark, d):
    f = _read(spark, d, "events").selectExpr(
        "event_id AS id", "event_id % 3000 AS job_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 8 END AS rating",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE repeat('x', CAST(4990 + event_id % 20 AS INT)) END AS comment"
    )
    return jobs.valid_feedback(f, _read(spark, d, "orders").selectExpr("o_orderkey AS job_id")).select("id")


def upload_validation(spark, d):
    p = _read(spark, d, "pages").selectExpr(
        "page_id", "concat('drawing_', page_id, element_at(array('.PDF', '.png', '.exe', '.tiff'), CAST(page_id % 4 AS INT) + 1)) AS name",
        "(page_id % 5) * 20000000 AS size"
    )
    return p.select("page_id", jobs.upload_status(F.col("name"), F.col("size"), S.max_upload_mb).alias("code"))


def result_gate(spark, d):
    asked = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()
    known = _read(spark, d, "orders").where("o_orderkey % 3 <> 0").selectExpr(
        "o_orderkey AS job_id", "CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'running' END AS status"
    )
    results = asked.where("job_id % 5 <> 0")
    return jobs.result_status(asked.join(known, "job_id", "left"), results).select("job_id", "code")


def text_join(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id AS id", "concat('M', event_id % 97, ' ', event_type) AS a",
        "concat(substring(event_type, CAST(event_id % 4 AS INT) + 1), '-', event_id % 7) AS b"
    )
    return e.select("id", T.merge_text(F.col("a"), F.col("b")).alias("joined"))


def ascii_labels(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.ascii_label(F.col("text")).alias("label"))


def state_upsert(spark, d):
    table = _read(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS status")
    return jobs.upsert(table, table.where("job_id % 10 = 0").withColumn("status", F.lit("archived")), ["job_id"])


def synthetic_drawings(spark, d):
    """A drawing for each part."""
    return synthetic.drawings(_read(spark, d, "part").select(F.col("p_partkey").alias("drawing")))


def synthetic_distances(spark, d):
    """Pairs of components of one drawing that come too near to each other: none; and how many components each drawing has."""
    seeds = _read(spark, d, "part").selectExpr("p_partkey AS drawing", "7 AS seed")
    p = F.filter("parts", lambda a: F.exists("parts", lambda b: (a["item"] < b["item"]) & synthetic.near(a, b["x"], b["y"], b["w"], b["h"])))
    return synthetic.placed(seeds).select("drawing", F.size("parts").cast("long").alias("components"), F.size(p).cast("long").alias("too_near"))


def empty_tiles(spark, d):
    images = _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("image_id"))
    found = _read(spark, d, "events").selectExpr(
        "CAST(event_id % 900 + 1 AS STRING) AS image_id", "format_string('Tile_%03d', CAST(event_id % 13 + 1 AS INT)) AS tile_id"
    )
    found = found.groupBy("image_id", "tile_id").agg(F.count("*").alias("n_items"))
    tiles = datasets.with_missing_tiles(found, tiling.tile_grid(spark, S), images)
    return datasets.sample_empty(tiles).select("image_id", "tile_id")


def resolve_models(spark, d):
    r = _read(spark, d, "customer").selectExpr("c_nationkey AS model", "c_mktsegment AS alias", "c_custkey AS version", "c_acctbal > 0 AS complete")
    return evaluation.resolve_models(r)


def last_metrics(spark, d):
    log = _read(spark, d, "events").selectExpr(
        "user_id AS run", "event_id AS line", "CASE WHEN event_id % 3 = 0 THEN concat('epoch ', event_id) ELSE props END AS text"
    )
    return evaluation.last_metrics(log, "k")


def _fit(spark, d) -> DataFrame:
    """One drawing size for each page of the events."""
    pages = _read(spark, d, "events").selectExpr(f"{fixtures.PAGE} AS page").distinct()
    return tiling.canvas_fit(pages.selectExpr("page", "CAST(900 + (page * 37) % 5000 AS INT) AS orig_w", "CAST(700 + (page * 91) % 4000 AS INT) AS orig_h"), S)


def original_coords(spark, d):
    rows = reduce(DataFrame.unionByName, [fixtures.truth(spark, d, k) for k in fixtures.KINDS])
    out = results.original_coords(rows, _fit(spark, d))
    return out.select("page", "id", "kind", *[F.round(f"g{i}", 6).alias(f"g{i}") for i in range(4)])


def canvas_coords(spark, d):
    pages = _fit(spark, d).withColumns({"x": (F.col("page") % 89).cast("double"), "y": (F.col("page") % 53).cast("double")})
    x, y = G.to_canvas(F.col("x"), F.col("y"), {c: F.col(c) for c in results.CANVAS})
    return pages.select("page", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def segment_codec_forms(spark, d):
    """Segments of every form through their padded boxes and back: upright and level ones, and diagonals of both directions."""
    e = _read(spark, d, "events").selectExpr(
        "event_id AS id", "CAST(event_id % 900 AS DOUBLE) AS x", "CAST(event_id % 700 AS DOUBLE) AS y", "CAST(100 + event_id % 50 AS DOUBLE) AS n",
        "event_id % 4 AS form"
    )
    dx, dy = F.when(F.col("form") == 0, 0.0).otherwise(F.col("n")), F.when(F.col("form") == 1, 0.0).otherwise(F.col("n"))
    up = F.col("form") == 3
    line = (F.col("x"), F.when(up, F.col("y") + dy).otherwise(F.col("y")), F.col("x") + dx, F.when(up, F.col("y")).otherwise(F.col("y") + dy))
    back = G.box_to_segment(G.segment_to_box(line), up=up)
    return e.select("id", *[v.alias(f"s{i}") for i, v in enumerate(back)])


def page_result(spark, d):
    """The nested documents of all pages, told by what they hold."""
    det = kept(merging.apply_thresholds(fixtures.detections(spark, d, S), S))
    merged, report = prediction.merge_pages(det, S)
    out = results.page_results(det, merged, _fit(spark, d), report)
    items = F.aggregate("tiles", F.lit(0), lambda n, t: n + sum((F.size(t["items"][k]) for k in results.LISTS.values()), F.lit(0)))
    counts = [F.col(f"counts.`{k}`").cast("long").alias(n) for k, n in zip(results.LISTS.values(), ("objects", "texts", "arrows"))]
    first = F.get(F.col("merged_original_coords.`OBJECT/COMPONENT`"), F.lit(0))["geometry"]
    return out.select(
        "page", F.size("tiles").cast("long").alias("tiles"), items.cast("long").alias("items"), *counts, F.size(first).cast("long").alias("corners"),
        "merge_report.pairs", "merge_report.llm_calls"
    )


def merged_view(spark, d):
    det = merging.apply_thresholds(fixtures.detections(spark, d, S, "ocr"), S)
    merged, report = prediction.merge_pages(det, S)
    out = results.merged_view(results.page_results(det, merged, _fit(spark, d), report))
    assert "tiles" not in out.columns
    return out.select("page", F.col("counts.OCR").cast("long").alias("texts"), F.size("merged.OCR").cast("long").alias("listed"))


def build_datasets(spark, d):
    """A training set over all events, told by what each tile holds: label lines, COCO annotations, text crops."""
    found = fixtures.detections(spark, d, S).withColumn("image_id", F.concat(F.lit("P"), F.col("page").cast("string")))
    images = _read(spark, d, "events").selectExpr(f"concat('P', {fixtures.PAGE} * 2) AS image_id")  # half of them without annotation
    images = images.unionByName(found.select("image_id")).distinct()
    built = datasets.build(images, found, tiling.tile_grid(spark, S))
    coco = built.coco_images.withColumn("name", F.regexp_replace("file_name", r"\.png$", "")).join(
        built.coco_annotations.groupBy("split", F.col("image_id").alias("id")).agg(F.count("*").alias("n_coco")), ["split", "id"], "left"
    )
    crops = built.ocr.groupBy(F.col("tile").alias("name")).agg(F.count("*").alias("n_crops"))
    lines = F.when(F.col("lines") == "", 0).otherwise(F.size(F.split("lines", "\n"))).cast("long")
    out = built.yolo.join(coco.select("name", "n_coco", "width", F.col("id").alias("coco_id")), "name").join(crops, "name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("split", "name", lines.alias("n_lines"), zero("n_coco"), zero("n_crops"), "width", "coco_id")


def dataset_categories(spark, d):
    """The images are the pages of all events, so that arrows are cut once, for their labels."""
    found = fixtures.detections(spark, d, S, "arrow").withColumn("image_id", F.col("page").cast("string"))
    images = _read(spark, d, "events").selectExpr(f"CAST({fixtures.PAGE} AS STRING) AS image_id")
    return datasets.build(images, found, tiling.tile_grid(spark, S)).coco_categories


def job_view(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id % 500 AS job_id", "ts", "element_at(array('queued', 'running', 'succeeded', 'failed'), CAST(event_id % 4 AS INT) + 1) AS status",
        "CAST(null AS STRING) AS error"
    )
    seen = results.job_view(jobs.job_state(e).withColumn("input_file_id", F.lit("hidden")))
    return seen.select("job_id", "status", "seconds")


def job_drift(spark, d):
    return results.job_drift(_read(spark, d, "events").selectExpr(
        "user_id AS job_id", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 5 = 0 END AS drift"
    ))


def readiness(spark, d):
    checks = _read(spark, d, "events").groupBy(F.col("user_id").alias("service"), F.col("event_type").alias("name")).agg((F.min("value") > 1).alias("ok"))
    return results.readiness(checks).withColumn("failing", F.array_join("failing", ","))


def readable_texts(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id AS id", "element_at(array('--', '25.4', '?!', 'THRU', '§', ''), CAST(event_id % 6 AS INT) + 1) AS text",
        "CAST(event_id % 100 AS DOUBLE) / 100 AS conf"
    )
    return evaluation.readable(e).select("id")


def clean_metrics(spark, d):
    e = _read(spark, d, "events").selectExpr(
        "event_id AS id", "map(' val loss$', CAST(value AS STRING), 'name', event_type, 'n', CAST(event_id AS STRING)) AS m"
    )
    return e.select("id", F.explode(jobs.clean_metrics(F.col("m"))).alias("name", "number"))


def draw_commands(spark, d):
    rows = reduce(DataFrame.unionByName, [fixtures.truth(spark, d, k) for k in fixtures.KINDS])
    return prediction.draw_commands(rows).select("id", "kind", "shape", "caption")


def request_rates(spark, d):
    logs = _read(spark, d, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS path", "value AS latency_ms")
    out = detections_stream.request_rates(logs, window="1 day")
    return out.select(F.to_date("window.start").alias("day"), "path", "n", F.round("mean_ms", 6).alias("mean_ms"))


def state_patch(spark, d):
    table = _read(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS status", "o_orderpriority AS note")
    rows = table.where("job_id % 10 < 3").selectExpr(
        "job_id + (CASE WHEN job_id % 10 = 2 THEN 100000000 ELSE 0 END) AS job_id", "CASE WHEN job_id % 10 = 0 THEN NULL ELSE 'moved' END AS status",
        "note AS reason"
    )
    return jobs.patch(table, rows, ["job_id"])


def page_names(spark, d):
    p = _read(spark, d, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber - 1 AS page").distinct()
    n = p.groupBy("file").agg(F.count("*").alias("n_pages"))
    return p.join(n, "file").select(
        "file", "page", results.image_id(F.concat(F.lit("F"), F.col("file").cast("string")), F.col("page"), F.col("n_pages")).alias("image_id")
    )


def stored_files(spark, d):
    docs = _read(spark, d, "pages").selectExpr(
        "page_id AS image_id", "CASE page_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'a.TIFF' ELSE 'b.jpg' END AS filename",
        "CAST(html AS BINARY) AS content", "CASE WHEN page_id % 4 = 0 THEN NULL ELSE '{}' END AS annotation"
    )
    images, notes = store.export(docs)
    return images.select("path", F.length("content").cast("long").alias("n")).unionByName(notes.select("path", F.length("value").cast("long").alias("n")))


def job_replay(spark, d):
    """Every event of the jobs, with whether it could follow the state that it met."""
    e = _read(spark, d, "events").selectExpr(
        "event_id % 700 AS job_id", "event_id AS seq", "ts", "element_at(array('queued', 'running', 'succeeded', 'failed'), CAST((event_id DIV 3) % 4 AS INT) + 1) AS status",
        "CAST(null AS STRING) AS error"
    )
    return jobs.replay(e).select("job_id", "seq", "status", "was", "accepted")


def job_champions(spark, d):
    """Each event as a job, with the champion and the baseline of its model at that time; some models have neither at first."""
    e = _read(spark, d, "events").selectExpr("event_id", "event_type AS model", "ts", "value", "user_id")
    jobs_ = e.select(F.col("event_id").alias("job_id"), "model", "ts")
    tried = e.where("event_id % 3 = 0").selectExpr("model", "event_id AS version", "date_trunc('hour', ts) AS ts", "value AS metric")
    published = e.where("user_id % 10 = 0").selectExpr("model", "date_trunc('day', ts) AS ts", "event_id AS baseline")
    return evaluation.at_the_time(jobs_, tried, published).select("job_id", "model", "version", "baseline")


def page_items(spark, d):
    """Every item of the documents of all pages as it stands there: list, place, coordinates on the canvas and in the image, label, confidence, tiles."""
    det = kept(merging.apply_thresholds(fixtures.detections(spark, d, S), S))
    merged, report = prediction.merge_pages(det, S)
    docs = kept(results.page_results(det, merged, _fit(spark, d), report))
    parts = []
    for kind, name in results.LISTS.items():
        both = F.arrays_zip(F.col(f"merged.`{name}`").alias("m"), F.col(f"merged_original_coords.`{name}`").alias("o"))
        rows = docs.select("page", F.lit(kind).alias("kind"), F.posexplode(both).alias("place", "x"))
        parts.append(rows.select(
            "page", "kind", F.col("place").cast("long").alias("place"), *[F.round(F.col("x.m.geometry")[i], 6).alias(f"g{i}") for i in range(4)],
            *[F.col("x.o.geometry")[i].alias(f"o{i}") for i in range(4)], F.col("x.o.label").alias("label"), F.col("x.o.confidence").alias("confidence"),
            F.array_join("x.o.source_tiles", ",").alias("source_tiles"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _echo(instructions: str, payload: str) -> str:
    """A stand-in for a model: it takes what geometry proposes."""
    return json.dumps({"merges": [{"ids": pair} for pair in json.loads(payload)["hints"]], "relabels": []})


def merge_by_decisions(spark, d):
    """Objects of all pages merged by decisions that are asked once each and remembered, of a model that agrees with geometry."""
    cands = _cands(spark, d, "object")
    near = merging.seam_candidates(cands, S)
    path = new_path(spark)
    memory = StateTable(spark, path, ["key"], 8)
    decided = decisions.decide_once(near, merging.match_edges(near, S, kinds=("object",)), _echo, memory, per_task=2_000)
    edges = decided.where("kind <> 'call' AND src <> dst").select("page", "src", "dst")
    out = _out(merging.fuse_objects(merging.grouped(cands, merging.components(edges))))
    remove(spark, path)
    return out


def layout_pairs(spark, d):
    return layouts.pairs(fixtures.layout(spark, d), S.seam_margin)


def layout_slices(spark, d):
    return fixtures.layout_detections(spark, d, S).select("page", "id", "tile_id", F.col("item_idx").cast("long").alias("item_idx"), "g0", "g1", "g2", "g3", "label")


def layout_arrows(spark, d):
    cut = layouts.cut_segments(fixtures.truth(spark, d, "arrow"), fixtures.layout(spark, d), S.min_segment)
    return cut.select("page", "id", "tile_id", *[F.round(f"g{i}", 6).alias(f"g{i}") for i in range(4)])


def layout_merge(spark, d):
    """Objects merged over the seams of each page's own tiles."""
    tiles = fixtures.layout(spark, d)
    cands = kept(merging.candidates(merging.apply_thresholds(fixtures.layout_detections(spark, d, S), S), S, layout=tiles))
    edges = merging.match_edges(merging.seam_candidates(cands, S, layout=tiles), S, kinds=("object",))
    return _out(merging.fuse_objects(merging.grouped(cands, merging.components(edges))))


def line_peaks(spark, d):
    runs = lines.runs_of(fixtures.strokes(spark, d), ("tile",))
    return lines.peaks(runs, ("tile",)).select("tile", "angle", "rho", "votes")


def line_votes(spark, d):
    """The longest lines of each tile's ink, with their score."""
    runs = kept(lines.runs_of(fixtures.strokes(spark, d), ("tile",)))  # votes and claims both read them
    found = lines.lines(runs, ("tile",))
    scored = evaluation.longest_lines(found.withColumns({"ord": F.struct("angle", "rho", "t0"), "diag": F.lit(1448.0)}), by=("tile",))
    return scored.select("tile", "angle", "rho", "votes", "t0", "t1", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("score", 9).alias("score"))


QUERIES = {
    **{f.__name__: f for f in (
        tile_starts, tile_grid, tile_pairs, canvas_fit, coords_round_trip, box_iou_pairs, segment_box_codec, apply_thresholds, seam_candidates, active_pairs, components,
        merge_objects, merge_arrows, merge_text, text_groups, merged_pages, class_vote, merge_report, page_counts, drift_profile, average_profile, drift_compare, rolling_baseline,
        recent_profiles, latest_baseline, split_assignment, class_index, yolo_labels, coco_annotations, ocr_crops, manifest, ocr_cer, champion_promotion, word_lines, hough_topk,
        contour_gate, text_gate, recent_jobs, job_state, request_log_summary, feedback_valid, upload_validation, result_gate, text_join, ascii_labels, state_upsert, synthetic_drawings, synthetic_distances, empty_tiles, resolve_models, last_metrics,
        original_coords, canvas_coords, segment_codec_forms, page_result, merged_view, build_datasets, dataset_categories, job_view, job_drift, readiness, readable_texts,
        clean_metrics, draw_commands, request_rates, state_patch, page_names, stored_files,
        layout_pairs, layout_slices, layout_arrows, layout_merge, job_replay, job_champions, page_items, merge_by_decisions, line_peaks, line_votes,
    )},
    "slice_objects": _slices("object"), "slice_text": _slices("ocr"), "slice_arrows": _slices("arrow", 6),
    "match_objects": _matches("object"), "match_arrows": _matches("arrow"), "match_text": _matches("ocr"),
    "match_objects_dense": _matches("object", fixtures.DENSE),
}
