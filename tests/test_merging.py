"""Merging on a 2 x 2 grid of 600 px tiles that share strips of 100 px (x or y from 500 to 600)."""

import random

import pytest
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.operators import merging
from sheetweave.operators.tiling import tile_grid, tile_pairs, tile_starts
from sheetweave.settings import Settings

S = Settings(canvas_width=1100, canvas_height=1100, tile_size=600, tile_overlap=100)
SCHEMA = "page int, tile_idx int, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string, confidence double"


def run(spark, rows):
    items = [(1, 0, t, k, i, *map(float, g), label, c) for t, k, i, g, label, c in rows]
    return merging.in_order(merging.merge(spark.createDataFrame(items, SCHEMA), S)).orderBy("kind", "place").collect()


def box(r):
    return [r[f"g{i}"] for i in range(4)]


def test_grid_and_pairs(spark):
    assert tile_starts(3000, 800, 200) == [0, 600, 1200, 1800, 2200]
    assert tile_starts(700, 800, 200) == [0] and tile_starts(800, 800, 200) == [0] and tile_starts(801, 800, 200) == [0, 1]
    assert tile_pairs(tile_grid(spark, S), 48).count() == 4
    assert tile_pairs(tile_grid(spark, Settings()), 48).count() == 36
    abut = Settings(canvas_width=900, canvas_height=300, tile_size=300, tile_overlap=0)
    assert [(r.o0, r.o2) for r in tile_pairs(tile_grid(spark, abut), 48).orderBy("pair_ord").collect()] == [(300.0, 0.0), (600.0, 0.0)]


def test_line_across_a_seam(spark):
    # A slanted line from (220, 70) to (940, 250), cut by the tiles' edges at x = 600 and x = 500.
    (r,) = run(spark, [("Tile_001", "arrow", 0, (220, 70, 600, 165), "cut_line", 0.55), ("Tile_002", "arrow", 0, (0, 140, 440, 250), "pointer", 0.75)])
    assert box(r) == [220, 70, 940, 250] and r.label == "pointer" and r.source_tiles == ["Tile_001", "Tile_002"] and (r.members, r.confidence) == (2, 0.75)


def test_lines_that_only_run_alike_stay_apart(spark):
    beside = [("Tile_001", "arrow", 0, (220, 340, 600, 340), "x", None), ("Tile_002", "arrow", 0, (0, 352, 300, 352), "x", None)]
    turned = [("Tile_001", "arrow", 1, (300, 440, 600, 440), "x", None), ("Tile_002", "arrow", 1, (90, 440, 300, 470), "x", None)]
    rows = run(spark, beside + turned)
    assert len(rows) == 4 and all(r.confidence is None and r.members == 1 for r in rows)


def test_cut_and_repeated_boxes(spark):
    rows = run(spark, [
        ("Tile_001", "object", 0, (530, 410, 52, 36), "valve", 0.62), ("Tile_001", "object", 1, (450, 130, 150, 80), "pump", 0.41),
        ("Tile_002", "object", 0, (31, 409, 52, 37), "valve", 0.81), ("Tile_002", "object", 1, (0, 130, 170, 80), "tank", 0.4),
    ])
    assert [(box(r), r.label) for r in rows] == [([450, 130, 220, 80], "pump"), ([530, 409, 53, 37], "valve")] and rows[1].confidence == 0.81


def test_text_fragments(spark):
    (r,) = run(spark, [("Tile_001", "ocr", 0, (520, 315, 80, 24), "R12.7", 0.7), ("Tile_002", "ocr", 0, (70, 316, 60, 24), "2.75 MAX", 0.8)])
    assert r.label == "R12.75 MAX"
    assert box(r) == [520, 315, 110, 25]


def test_one_shared_character_does_not_join(spark):
    (r,) = run(spark, [("Tile_001", "ocr", 0, (515, 60, 70, 22), "8H", 0.9), ("Tile_002", "ocr", 0, (75, 60, 60, 22), "H7", 0.9)])
    assert r.label == "8H H7"


def test_horizontal_seam_and_three_tiles(spark):
    parts = [("Tile_001", (525, 530, 60, 44), "bolt", 0.45), ("Tile_002", (25, 530, 60, 44), "bolt", 0.5), ("Tile_003", (525, 30, 60, 44), "nut", 0.9)]
    (r,) = run(spark, [(t, "object", 0, g, label, c) for t, g, label, c in parts])
    assert r.members == 3 and r.label == "bolt" and r.source_tiles == ["Tile_001", "Tile_002", "Tile_003"]


def test_vote_ties(spark):
    rows = [(1, "r", "cog", None, 0), (1, "r", "gear", 0.5, 1), (1, "s", "left", 0.25, 7), (1, "s", "east", 0.25, 9)]
    members = spark.createDataFrame(rows, "page int, root string, label string, confidence double, ord long")
    assert {r.root: r.label for r in merging.vote(members, ["page", "root"]).collect()} == {"r": "gear", "s": "left"}


def test_thresholds_are_inclusive_and_pass_nulls(spark):
    rows = [(1, 0, "Tile_001", k, i, 0.0, 0.0, 9.0, 9.0, "x", c) for i, (k, c) in enumerate([
        ("object", 0.25), ("object", 0.24), ("arrow", 0.3), ("ocr", 0.29), ("ocr", None)
    ])]
    kept = merging.apply_thresholds(spark.createDataFrame(rows, SCHEMA), S)
    assert sorted(r.item_idx for r in kept.select("item_idx").collect()) == [0, 2, 4]


@pytest.mark.parametrize("most", [1_000, 5])
def test_components_follow_chains(spark, most):
    n = 40
    rows = [(1, f"u{i:03d}", f"u{i + 1:03d}") for i in range(n)] + [(2, "u000", "u001"), (2, "u005", "u002"), (2, "u005", "u009")]
    edges = spark.createDataFrame(rows, "page int, src string, dst string")
    got = merging.components(edges, most=most).groupBy("page", "root").agg(F.count("*").alias("n")).collect()
    assert {(r.page, r.root, r.n) for r in got} == {(1, "u000", n + 1), (2, "u000", 2), (2, "u002", 3)}


def test_empty(spark):
    assert merging.merge(spark.createDataFrame([], SCHEMA), S).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"), [("R12.", "12.5", "R12.5"), ("NOTE", "NOTE", "NOTE"), ("2X", "R3", "2X R3"), ("", "z", "z"), ("TYP", "TYPICAL", "TYPICAL")]
)
def test_merge_text(spark, a, b, want):
    from sheetweave.functions.text import merge_text

    assert spark.createDataFrame([(a, b)], "a string, b string").select(merge_text(F.col("a"), F.col("b"))).first()[0] == want


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def shares(a, b, s=0.5):
    i = overlap(a, b)
    return i / (a[2] * a[3] + b[2] * b[3] - i + 1e-9) >= s


def test_bands_lose_no_match_on_a_crowded_page(spark):
    """All items of one seam against each other, by the rules in plain Python."""
    rng = random.Random(21)
    rows = []
    for kind in ("object", "ocr", "arrow"):
        for i in range(150):
            x, y = rng.randint(430, 590), rng.randint(0, 560)
            w, h = (rng.randint(10, 120), rng.randint(8, 40)) if kind != "object" else (rng.randint(10, 160), rng.randint(10, 300))
            for tile, x0, x1 in (("Tile_001", 0, 600), ("Tile_002", 500, 1100)):
                lo, hi = max(x, x0), min(x + w, x1)
                if hi - lo > 4:
                    g = (lo - x0, y, hi - x0, y + rng.randint(0, 3)) if kind == "arrow" else (lo - x0, y + rng.randint(0, 2), hi - lo, min(h, 600 - y))
                    rows.append((1, 0, tile, kind, i, *map(float, g), "l", 0.9))
    cands = merging.candidates(spark.createDataFrame(rows, SCHEMA), S)
    near = merging.seam_candidates(cands, S).where("orientation = 'vertical' AND pair_ord = 1")
    got = {(r.src, r.dst) for r in merging.match_edges(near, S).collect()}
    items = [r for r in near.collect()]
    want, cut = set(), (498.0, -2.0, 104.0, 604.0)
    within = lambda g: (
        max(g[0], cut[0]), max(g[1], cut[1]), min(g[0] + g[2], cut[0] + cut[2]) - max(g[0], cut[0]),
        min(g[1] + g[3], cut[1] + cut[3]) - max(g[1], cut[1])
    )
    arrows = []
    for a in (r for r in items if r.side == "a"):
        for b in (r for r in items if r.side == "b" and r.kind == a.kind):
            p, q = box(a), box(b)
            if a.kind == "arrow":
                arrows.append((a.uid, b.uid, *p, *q))
                continue
            hit = overlap(p, cut) > 0 and overlap(q, cut) > 0 and shares(within(p), within(q))
            if a.kind == "object":
                hit = hit or shares(p, q)
            else:
                low, high = min(p[3], q[3]), max(p[3], q[3])
                hit = hit or (abs(p[1] + p[3] / 2 - q[1] - q[3] / 2) <= 0.5 * low and low / high >= 0.6 and max(q[0] - p[0] - p[2], p[0] - q[0] - q[2]) <= 24)
            if hit:
                want.add((a.uid, b.uid))
    lines = spark.createDataFrame(arrows, "src string, dst string, " + ", ".join(f"{e}{i} double" for e in "pq" for i in range(4)))
    p, q = G.quad("p"), G.quad("q")
    rule = (G.angle_difference(G.angle(p), G.angle(q)) <= 5) & (F.greatest(G.line_distance(q[0], q[1], p), G.line_distance(q[2], q[3], p)) <= 6) & (G.segment_gap(p, q) <= 24)
    want |= {(r.src, r.dst) for r in lines.where(rule).collect()}
    assert got == want and {s.split(":")[1] for s, _ in want} == {"object", "ocr", "arrow"}


@pytest.mark.parametrize("kind", merging.KINDS)
def test_matching_is_compiled_and_its_rules_stay_out_of_the_join_with_tiles(spark, kind):
    rows = [(1, 0, "Tile_001", kind, 0, 430.0, 40.0, 590.0, 40.0, "l", 0.9), (1, 0, "Tile_002", kind, 0, 0.0, 40.0, 90.0, 40.0, "l", 0.9)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = merging.match_edges(merging.seam_candidates(merging.candidates(spark.createDataFrame(rows, SCHEMA), S), S), S, kinds=(kind,))
        plan = edges._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = plan.explainString(mode)
        met = [x for x in plan.executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [int(part.split(";")[0]) for part in code.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8_000  # the JVM compiles no longer method
    assert met and not any("struct(" in x for x in met)


@pytest.mark.parametrize("least", [0.5, 0.3, 0.9])
def test_crowded_seams_match_the_same_objects(spark, least):
    """Boxes of all sizes, near twins, whole and broken coordinates; the overlap of pair 2 is shorter than the boxes, so cut and whole stretches differ."""
    rng = random.Random(least)
    rows = []
    for n in range(900):
        x, y, w, h = rng.choice([(rng.randrange(60), rng.randrange(200), rng.choice([1, 8, 16, 40]), rng.choice([2, 16, 32, 64])), (rng.random() * 60, rng.random() * 200, rng.random() * 70, rng.random() * 99)])
        pair, orientation, over = rng.choice([(1, "vertical", (20, 0, 40, 300)), (2, "vertical", (20, 60, 40, 50)), (3, "horizontal", (0, 90, 300, 40))])
        g = [float(v) for v in (x, y, w, h)]
        for side in "ab" if rng.random() < 0.5 else rng.choice("ab"):
            rows.append((n % 2, "object", pair, side, f"{side}{n}", *g, *g, *map(float, over), orientation))
            g[1] += rng.choice([0, 1, h / 3])
            g[3] *= rng.choice([1, 0.5, 0.9])
    names = ", ".join(f"{p}{i} double" for p in "gbo" for i in range(4))
    near = spark.createDataFrame(rows, f"page int, kind string, pair_ord int, side string, uid string, {names}, orientation string")
    s = Settings(overlap_iou=least)
    want, got = (sorted(map(tuple, merging.match_edges(near, s, kinds=("object",), crowded=c).collect())) for c in (False, True))
    assert got == want and len(want) > 20


def test_components_of_many_pages_are_found_at_once(spark):
    rng, rows, want = random.Random(9), [], {}
    for page in [*range(40), None]:
        for part in ("x", None):
            root = {}
            for _ in range(rng.choice((1, 2, 5, 30))):
                a, b = (f"u{rng.randrange(rng.choice((1, 3, 12, 40)))}é" for _ in range(2))
                rows.append((page, part, a, b))
                x, y = root.setdefault(a, a), root.setdefault(b, b)
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
            want |= {(page, part, k): r for k, r in root.items()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")  # pages go on from batch to batch
    try:
        got = merging.components(spark.createDataFrame(rows, "page int, part string, src string, dst string"), ("page", "part"))
    finally:
        spark.conf.set(key, before)
    assert {(r.page, r.part, r.uid): r.root for r in got.collect()} == want
