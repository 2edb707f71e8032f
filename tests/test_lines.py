"""Lines by votes against plain loops over pixels, and what they see that connected strokes cannot."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sheetweave.operators import lines, prediction, predictors
from sheetweave.plans import job
from sheetweave.settings import Settings
from sheetweave.sources import images
from tests.test_sources import S, drawing

POINTS = "tile string, x int, y int"


def plain(points, votes, shortest, gap):
    """{(tile, angle, rho, votes, t0, t1)} by looking at every pixel, place and peak."""
    out = set()
    turn = [(round(math.cos(math.radians(a)) * 65536), round(math.sin(math.radians(a)) * 65536)) for a in range(180)]
    for tile in {p[0] for p in points}:
        pixels = {(x, y) for t, x, y in points if t == tile and None not in (x, y)}
        at = lambda a, x, y: (x * turn[a][0] + y * turn[a][1] + 32768) >> 16
        counts = {}
        for x, y in pixels:
            for a in range(180):
                counts[a, at(a, x, y)] = counts.get((a, at(a, x, y)), 0) + 1
        held = {k: n for k, n in counts.items() if n >= votes}
        rank = lambda k: (held[k], -k[0], -k[1])

        def near(k, o):
            return any(abs(o[0] + turn_ - k[0]) <= 2 and abs(sign * o[1] - k[1]) <= 2 for turn_, sign in ((0, 1), (180, -1), (-180, -1)))

        found = [k for k in held if not any(near(k, o) and rank(o) > rank(k) for o in held)]
        for a, rho in found:
            places = {}
            for x, y in pixels:
                if abs(at(a, x, y) - rho) <= 1:
                    best = max((k for k in found if abs(at(k[0], x, y) - k[1]) <= 2), key=rank)
                    t = (y * turn[a][0] - x * turn[a][1] + 32768) >> 16
                    places[t] = places.get(t, False) or best == (a, rho)
            parts = []
            for t in sorted(places):
                if not parts or t - parts[-1][-1] > gap + 1:
                    parts.append([])
                parts[-1].append(t)
            for p in parts:
                if p[-1] - p[0] >= shortest and 2 * sum(places[t] for t in p) >= len(p):
                    out.add((tile, a, rho, held[a, rho], p[0], p[-1]))
    return out


def seen(spark, points, **how):
    runs = lines.runs_of(spark.createDataFrame(points, POINTS), ("tile",))
    return lines.lines(runs, ("tile",), **how).collect()


def stroke(tile, x, y, angle, n, dash=0, wide=1):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [(tile, round(x + i * c - w * s), round(y + i * s + w * c)) for i in range(n + 1) if not dash or i % (2 * dash) < dash for w in range(wide)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pixel(spark, seed):
    rng = random.Random(seed)
    points = [(None, rng.randrange(60), 4) for _ in range(90)] + [("a", None, 3), ("a", 4, None)]
    for tile in "aaaab":
        points += stroke(tile, rng.randrange(20, 60), rng.randrange(20, 60), rng.choice([0, 1, 45, 90, 179, rng.randrange(180)]), rng.randrange(20, 50), rng.choice([0, 3]), rng.choice([1, 3]))
    points += [("b", rng.randrange(80), rng.randrange(80)) for _ in range(150)]
    got = seen(spark, points, votes=14, shortest=12, gap=3)
    assert {(r.tile, r.angle, r.rho, r.votes, r.t0, r.t1) for r in got} == plain(points, 14, 12, 3) and len(got) > 3
    for r in got:
        assert r.x1 <= r.x2 and (r.x1, r.y1) != (r.x2, r.y2) and abs(math.hypot(r.x2 - r.x1, r.y2 - r.y1) - r.len) < 0.01


def test_crossing_and_dashed(spark):
    points = stroke("x", 50, 50, 20, 200) + stroke("x", 60, 90, 0, 180) + stroke("d", 300, 20, 130, 250, dash=3) + stroke("w", 10, 10, 90, 100, wide=3)
    points += stroke("two", 0, 5, 0, 70) + stroke("two", 90, 5, 0, 70)
    got = {}
    for r in seen(spark, points):
        got.setdefault(r.tile, []).append(r)
    a, b = sorted(got["x"], key=lambda r: r.y1)
    assert np.allclose((a.x1, a.y1, a.x2, a.y2), (50, 50, 238, 118), atol=2) and np.allclose((b.x1, b.y1, b.x2, b.y2), (60, 90, 240, 90), atol=2)
    (d,) = got["d"]
    assert np.allclose(sorted([(d.x1, d.y1), (d.x2, d.y2)]), [(139.3, 211.5), (300, 20)], atol=4)
    (w,) = got["w"]  # three pixels wide is one line
    assert w.angle in (0, 1, 179) and np.allclose(sorted([w.y1, w.y2]), [10, 110], atol=2) and max(abs(w.x1 - 9), abs(w.x2 - 9)) <= 3
    assert sorted((r.x1, r.x2) for r in got["two"]) == [(0.0, 70.0), (90.0, 160.0)]
    # A stroke that is crossed is no straight piece of connected ink, and a dashed one is many short ones.
    page = np.full((260, 320, 3), 255, np.uint8)
    for _, x, y in points[: 201 + 181]:
        page[y, x] = 0
    assert predictors.StrokeDetector()(page, 0.0) == []


def test_empty_and_short(spark):
    assert seen(spark, []) == [] and seen(spark, stroke("s", 0, 0, 0, 50)) == []
    runs = spark.createDataFrame([("a", 3, 9, 2), ("a", None, 0, 90)], "tile string, y long, x0 long, x1 long")
    assert lines.lines(runs, ("tile",)).collect() == []
    twice = lines.runs_of(spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 1), ("a", 5, 1)], POINTS), ("tile",))
    assert sorted(map(tuple, twice.select("y", "x0", "x1").collect())) == [(1, 1, 2), (1, 5, 5)]


def test_nothing_moves_after_the_tiles_are_placed(spark):
    runs = lines.runs_of(spark.createDataFrame(stroke("a", 0, 0, 0, 80), POINTS), ("tile",))
    plan = lines.peaks(runs, ("tile",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning(key") == 1


def test_votes_are_no_rows(spark):
    runs = lines.runs_of(spark.createDataFrame(stroke("a", 0, 0, 0, 80), POINTS), ("tile",))
    for found in (lines.peaks(runs, ("tile",)), lines.lines(runs, ("tile",))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning(key") == 1


def test_pixels_move_twice_and_no_group_is_opened_for_a_tile(spark):
    runs = lines.runs_of(spark.createDataFrame(stroke("a", 0, 0, 0, 80), POINTS), ("tile",))
    for found in (lines.peaks(runs, ("tile",)), lines.lines(runs, ("tile",))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_a_tile_goes_on_over_batches(size):
    keys = [("a", 1.0)] * 3 + [("a", 2.0)] + [("a", None)] * 2 + [(None, float("nan"))] * 5 + [(None, None)] * 2
    t = pa.table({"key": pa.array([{"p": p, "q": q} for p, q in keys]), "y": range(13), "x0": range(13), "x1": range(13)})
    got = [(k, ink) for held in lines._tiles(t.to_batches(max_chunksize=size)) for k, ink in zip(*held)]
    assert [list(ink[0]) for _, ink in got] == [[0, 1, 2], [3], [4, 5], [6, 7, 8, 9, 10], [11, 12]]
    assert [k.to_pylist()[0]["p"] for k, _ in got] == ["a", "a", "a", None, None] and list(lines._tiles(iter([]))) == []


def test_peaks_are_those_of_each_place(monkeypatch):
    rng = np.random.default_rng(4)
    code = np.sort(rng.choice(180 * 61, 2_000, replace=False))
    angle, rho, n = code // 61, code % 61 - 30, rng.integers(1, 5, 2_000)
    held = {(a, r): (v, -a, -r) for a, r, v in zip(angle.tolist(), rho.tolist(), n.tolist())}
    around = lambda a, r: ((((a + i) % 180), (r if 0 <= a + i < 180 else -r) + j) for i in range(-2, 3) for j in range(-2, 3))
    want = [not any(held.get(o, rank) > rank for o in around(*at)) for at, rank in held.items()]
    monkeypatch.setattr(lines, "STEP", 300)
    assert lines._peaks(angle, rho, n).tolist() == want and 0 < sum(want) < 2_000


def test_votes_of_wide_tiles_are_those_of_a_table(monkeypatch):
    rng = np.random.default_rng(3)
    y, x0 = rng.integers(0, 300, 400), rng.integers(-200, 300, 400)
    ink = y, x0, x0 + rng.integers(0, 9, 400)
    dense = lines._voted(ink, 9)
    monkeypatch.setattr(lines, "DENSE", 0)
    monkeypatch.setattr(lines, "STEP", 5_000)
    assert len(dense[0]) > 50 and all((a == b).all() for a, b in zip(dense, lines._voted(ink, 9)))


def test_a_job_with_lines_by_votes(spark, tmp_path):
    page = drawing()
    page[600:800, 600:602] = 0  # crosses the long line
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sheet.png").write_bytes(images.encode_png(page))
    s = Settings(**{**{f: getattr(S, f) for f in ("canvas_width", "canvas_height", "tile_size", "tile_overlap")}, "line_backend": "votes"})
    suite = prediction.default_suite(s)
    assert "arrow" not in suite.build() and suite.version.endswith("arrow=votes:1")
    (r,) = job.run(spark, str(tmp_path / "in"), str(tmp_path / "job"), s).collect()
    found = sorted(a.geometry for a in r.merged["Annotation Arrow"])
    assert len(found) == 2 and np.allclose(sorted(x for g in found for x in (g[0], g[2])), [300, 600, 600, 899], atol=2) and r.counts["OBJECT/COMPONENT"] == 1
