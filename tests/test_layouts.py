"""Tiles of each page: pairs and cuts against plain loops over all tiles, and merging over seams that the grid does not have."""

import itertools
import json
import random

from sheetweave.operators import layouts, merging, tiling
from sheetweave.settings import Settings
from sheetweave.sources import annotations


def plain_pair(a, b, margin):
    """(orientation, overlap, seam) of two boxes, a first, or None."""
    if a[0] != b[0] and a[1] != b[1]:
        return None
    x, y, x2, y2 = max(a[0], b[0]), max(a[1], b[1]), min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    if x2 > x and y2 > y:
        over = [x, y, x2 - x, y2 - y]
    elif a[1] == b[1] and (a[0] + a[2] == b[0] or b[0] + b[2] == a[0]):
        over = [min(a[0] + a[2], b[0] + b[2]), a[1], 0, min(a[3], b[3])]
    elif a[0] == b[0] and (a[1] + a[3] == b[1] or b[1] + b[3] == a[1]):
        over = [a[0], min(a[1] + a[3], b[1] + b[3]), min(a[2], b[2]), 0]
    else:
        return None
    seam = [over[0] - margin, over[1] - margin, over[2] + 2 * margin, over[3] + 2 * margin]
    return "vertical" if a[1] == b[1] else "horizontal", over, seam


def some_tiles(seed, pages=30):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        step = rng.choice([1, 300, 900, 5000])
        for i in range(rng.randrange(12)):
            rows.append((p, i, f"T{i}", *(float(rng.randrange(4) * step - step) for _ in range(2)), *(float(rng.choice([0, 1, 2, 3]) * step) for _ in range(2))))
    return rows


TILES = "page int, idx int, tile_id string, tx double, ty double, tw double, th double"


def test_pairs_of_irregular_tiles(spark):
    rows = some_tiles(41)
    got = {(r.page, r.a, r.b): (r.orientation, [r[f"o{i}"] for i in range(4)], [r[f"s{i}"] for i in range(4)]) for r in layouts.pairs(spark.createDataFrame(rows, TILES), 48).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and (pair := plain_pair(a[3:], b[3:], 48)):
                want[a[0], a[2], b[2]] = pair
    assert got == want and {"vertical", "horizontal"} == {w[0] for w in want.values()} and any(0 in w[1][2:] for w in want.values())
    assert layouts.pairs(spark.createDataFrame([], TILES), 48).count() == 0


def test_a_page_laid_out_like_the_grid_has_its_pairs(spark):
    s = Settings()
    grid = tiling.tile_grid(spark, s)
    tiles = layouts.numbered(grid.selectExpr("7 AS page", "tile_id", "tx", "ty", "tw", "th"))
    columns = ["a", "b", "orientation", *[f"{c}{i}" for c in "os" for i in range(4)]]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(layouts.pairs(tiles, s.seam_margin)) == rows(tiling.tile_pairs(grid, s.seam_margin))


def test_one_row_of_many_tiles_is_no_pairwise_comparison(spark):
    tiles = spark.range(5000).selectExpr("1 AS page", "CAST(id AS INT) AS idx", "CAST(id AS STRING) AS tile_id", "id * 900.0D AS tx", "0.0D AS ty", "1000.0D AS tw", "10.0D AS th")
    found = layouts.pairs(tiles, 48)
    assert found.count() == 4999
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cuts_against_all_tiles(spark):
    rng = random.Random(42)
    tiles = some_tiles(43)
    items = [(rng.randrange(30), n, *(float(rng.randrange(-900, 9000)) for _ in range(2)), *(float(rng.randrange(0, 2500)) for _ in range(2))) for n in range(300)]
    t = spark.createDataFrame(tiles, TILES)
    boxes = layouts.cut_boxes(spark.createDataFrame(items, "page int, id int, g0 double, g1 double, g2 double, g3 double"), t, 0.3).collect()
    want = set()
    for p, n, x, y, w, h in items:
        for q, _, tile, tx, ty, tw, th in tiles:
            x0, y0, x1, y1 = max(x, tx), max(y, ty), min(x + w, tx + tw), min(y + h, ty + th)
            if p == q and x1 > x0 and y1 > y0 and (x1 - x0) * (y1 - y0) >= 0.3 * w * h:
                want.add((n, tile, x0 - tx, y0 - ty, x1 - x0, y1 - y0))
    assert len(boxes) == len(want) > 30 and {(r.id, r.tile_id, r.g0, r.g1, r.g2, r.g3) for r in boxes} == want
    level = [(p, n, x, y, x + w, y) for p, n, x, y, w, _ in items]
    lines = layouts.cut_segments(spark.createDataFrame(level, "page int, id int, g0 double, g1 double, g2 double, g3 double"), t, 10).collect()
    want = set()
    for p, n, x, y, x2, _ in level:
        for q, _, tile, tx, ty, tw, th in tiles:
            a, b = max(x, tx), min(x2, tx + tw)
            if p == q and ty <= y <= ty + th and b - a >= 10:
                want.add((n, tile, round(a - tx, 6), y - ty, round(b - tx, 6)))
    assert {(r.id, r.tile_id, round(r.g0, 6), r.g1, round(r.g2, 6)) for r in lines} == want and len(lines) == len(want)


def test_annotations_with_tile_boxes_merge_over_their_own_seams(spark):
    """Two abutting tiles of 300 x 200, which the grid of the settings does not have, and a page that repeats a tile."""
    doc = lambda tile, box, items: json.dumps({"Image ID": "I", "Tile ID": tile, "tile_box": box, "OBJECT/COMPONENT": [{"object_Bounding_Box": b, "classification_type": "C", "confidence": 0.9} for b in items]})
    docs = [("p1", doc("L", [0, 0, 300, 200], [[250, 50, 60, 60]])), ("p1", doc("R", [300, 0, 300, 200], [[-8, 50, 60, 60], [200, 20, 20, 20]])), ("p2", doc("L", [0, 0, 300, 200], [[1, 1, 5, 5]]))]
    ann = annotations.parse(spark.createDataFrame(docs, "path string, value string"))
    tiles = layouts.numbered(annotations.tile_boxes(ann), ("path",))
    assert {(r.path, r.tile_id, r.idx, r.tx, r.tw) for r in tiles.collect()} == {("p1", "L", 0, 0, 300), ("p1", "R", 1, 300, 300), ("p2", "L", 0, 0, 300)}
    merged = merging.merge(annotations.to_detections(ann), Settings(), ("path",), layout=tiles).collect()
    assert sorted((r.path, r.g0, r.g2, r.members, tuple(r.source_tiles)) for r in merged) == [("p1", 250.0, 102.0, 2, ("L", "R")), ("p1", 500.0, 20.0, 1, ("R",)), ("p2", 1.0, 5.0, 1, ("L",))]
    far = annotations.parse(spark.createDataFrame([("p", doc("L", [0, 0, 3], []))], "path string, value string"))
    try:
        annotations.tile_boxes(far).collect()
    except Exception as e:
        assert "tile box must have 4 values" in str(e)
    else:
        raise AssertionError("a box of three numbers passed")


def test_pairs_of_few_sheets_with_many_tiles_are_never_sent_whole(spark):
    sheets = spark.range(0, 20, 1, 1).selectExpr("id AS page", "5000 AS width", "4000 AS height")
    found = layouts.pairs(tiling.page_grid(sheets, Settings()), 48)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert found.groupBy("page").count().select("count").distinct().count() == 1


def test_a_segment_meets_its_tile_once(spark):
    from sheetweave.operators import slicing

    items = spark.createDataFrame([(1, 10.0, 10.0, 2000.0, 900.0)], "page int, g0 double, g1 double, g2 double, g3 double")
    cut = slicing.slice_segments(items, Settings())
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("1.0E-12") == 10  # of both axes, in one place
    assert cut.count() == 3


def test_tiles_are_found_in_compiled_code(spark):
    """Neither a filter of arrays nor a formatted name, with boxes that begin and end at the edges of tiles."""
    from sheetweave.functions import geometry as G
    from sheetweave.operators import slicing

    s = Settings(canvas_width=960, canvas_height=700, tile_size=512, tile_overlap=64)
    boxes = list(itertools.product((0.0, 448.0, 512.0, 960.0), (0.0, 188.0, 512.0, 700.0), (0.0, 64.0, 500.0), (0.0, 64.0, 500.0)))
    items = spark.createDataFrame([*[(i, *b) for i, b in enumerate(boxes)], (-1, None, 1.0, 9.0, 9.0)], "id int, g0 double, g1 double, g2 double, g3 double")
    tiles = tiling.tile_grid(spark, s).collect()
    for inclusive in (False, True):
        cut = slicing._over_tiles(items, G.quad("g"), s, inclusive)
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "format_string" not in plan
        less = float.__le__ if inclusive else float.__lt__
        meets = lambda at, n, start, size: less(float(at), start + size) and less(start, float(at + n))
        want = {
            (i, t.idx, t.tile_id, t.tx, t.ty, t.tw, t.th) for i, (x, y, w, h) in enumerate(boxes) for t in tiles
            if meets(t.tx, s.tile_size, x, w) and meets(t.ty, s.tile_size, y, h)
        }
        got = [(r.id, r.tile_idx, r.tile_id, r.t0, r.t1, r.t2, r.t3) for r in cut.collect()]
        assert len(got) == len(want) > 100 and set(got) == want


def test_tiles_of_pages_are_never_sent_whole(spark):
    items = spark.createDataFrame([(1, 10.0, 10.0, 2000.0, 900.0)], "page int, g0 double, g1 double, g2 double, g3 double")
    tiles = tiling.page_grid(spark.createDataFrame([(1, 4096, 2896)], "page int, width int, height int"), Settings())
    for cut in (layouts.cut_boxes(items, tiles, 0.1), layouts.cut_segments(items, tiles, 10.0)):
        assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString() and cut.count() > 1
