"""State tables rewritten in part, job states and page assembly as streams, restarts among them."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import jobs, merging
from sheetweave.settings import Settings
from sheetweave.sources import annotations
from sheetweave.sources.state import Conflict, StateTable
from sheetweave.streaming import stateful

S = Settings()


def as_dict(df):
    return {r.job_id: r.asDict() for r in df.collect()}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", ["job_id"], buckets=8)
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = spark.range(200).selectExpr("id AS job_id", "'queued' AS status")
    assert table.upsert(rows) == 1 and table.read().count() == 200
    before = files(tmp_path / "t")
    assert len(before) == 8
    assert table.upsert(spark.createDataFrame([(5, "running"), (1000, "queued")], "job_id long, status string")) == 2
    after = files(tmp_path / "t")
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 2
    got = as_dict(table.read())
    assert len(got) == 201 and got[5]["status"] == "running" and got[6]["status"] == "queued"
    assert as_dict(table.read(1))[5]["status"] == "queued"
    assert table.patch(spark.createDataFrame([(5, None, "late"), (2000, "queued", None)], "job_id long, status string, note string")) == 3
    got = as_dict(table.read())
    assert got[5] == {"job_id": 5, "status": "running", "note": "late"} and got[7]["note"] is None and len(got) == 202
    assert table.delete(spark.createDataFrame([(5,), (77777,)], "job_id long")) == 4 and 5 not in as_dict(table.read())
    assert table.upsert(rows.limit(0)) == 4
    last = as_dict(table.read())
    table.vacuum(1)
    assert as_dict(table.read()) == last and table.versions() == [4] and len(list((tmp_path / "t/data").iterdir())) <= 4


def test_rows_put_in_beside_others_leave_their_files(spark, tmp_path, monkeypatch):
    from sheetweave.sources import state

    monkeypatch.setattr(state, "FOLDERS", 3)
    table, n = StateTable(spark, f"{tmp_path}/t", ["job_id"], buckets=2), 0
    rows = lambda lo: spark.range(lo, lo + 20).selectExpr("'new' AS status", "id AS job_id") if lo else spark.range(20).selectExpr("id AS job_id", "'new' AS status")
    for version in (1, 2, 3):
        before = files(tmp_path / "t")
        assert table.append(rows(n)) == version and before.items() <= files(tmp_path / "t").items()
        n += 20
        written = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t/data").count()
        assert table.read().count() == written == n and table.read().columns == ["job_id", "status"]
    assert table.append(rows(0).limit(0)) == 3 and table.get(job_id=45).count() == 1 and table.read(1).count() == 20
    assert table.append(rows(n)) == 4 and table.read().count() == 80  # each bucket lies in one folder again
    assert {len(state._listed(f)) for f in table.manifest()["folders"].values()} == {1}
    table.append(rows(80))
    assert table.upsert(spark.createDataFrame([(5, "old")], "job_id long, status string")) == 6 and as_dict(table.read())[5]["status"] == "old"
    table.vacuum(1)
    assert table.read().count() == 100 and table.get(job_id=99).count() == 1 and table.delete(spark.range(50).selectExpr("id AS job_id")) == 7 and table.read().count() == 50


def test_a_point_read_opens_one_bucket(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", ["job_id"], buckets=16)
    table.upsert(spark.range(500).selectExpr("id AS job_id", "id * 2 AS x"))
    row = table.get(job_id=123)
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert [r.x for r in row.collect()] == [246] and len({f.split("bucket_=")[1].split("/")[0] for f in row.inputFiles()}) == 1
    assert "PushedFilters" in plan and "EqualNullSafe(job_id,123)" in plan.replace(" ", "")
    assert table.get(job_id=-1).count() == 0


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = StateTable(spark, f"{tmp_path}/t", ["job_id"], buckets=4)
    table.upsert(spark.range(50).selectExpr("id AS job_id", "'old' AS status"))
    bad = spark.range(50).selectExpr("id AS job_id", "CASE WHEN id = 33 THEN CAST(raise_error('lost') AS STRING) ELSE 'new' END AS status")
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    monkeypatch.setattr(table, "_publish", lambda m: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # everything written, but for the manifest
        table.upsert(spark.range(50).selectExpr("id AS job_id", "'new' AS status"))
    again = StateTable(spark, f"{tmp_path}/t", ["job_id"])
    assert {r.status for r in again.read().collect()} == {"old"} and again.manifest()["buckets"] == 4
    assert again.upsert(spark.range(50).selectExpr("id AS job_id", "'new' AS status")) == 2
    assert [r.status for r in again.read().groupBy("status").count().collect()] == ["new"]


def test_two_writers_of_one_version_do_not_both_end(spark, tmp_path):
    a = StateTable(spark, f"{tmp_path}/t", ["job_id"], buckets=4)
    rows = spark.range(10).selectExpr("id AS job_id", "'x' AS status")
    a.upsert(rows)
    stale = a.manifest()
    a.upsert(rows)
    b = StateTable(spark, f"{tmp_path}/t", ["job_id"])
    b.manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        b.upsert(rows)
    assert a.versions() == [1, 2] and a.read().count() == 10


def plain_replay(events):
    """{(job, seq): (was, accepted)} by walking through each job's events in order."""
    out, state = {}, {}
    for job, seq, ts, status, _ in sorted(set(events), key=lambda e: (e[2], jobs.RANK.get(e[3], -1), e[1])):
        was = state.get(job)
        taken = status in jobs.FOLLOWS.get(was, ())
        out[job, seq] = (was, taken)
        if taken:
            state[job] = status
    return out


def some_events(seed, n=400):
    rng = random.Random(seed)
    at = dt.datetime(2024, 5, 1)
    return [(f"j{rng.randrange(40)}", i, at + dt.timedelta(seconds=rng.randrange(30)), rng.choice([*jobs.STATES, "queued", "running", "odd"]), None) for i in range(n)]


def test_replay_equals_a_walk(spark):
    events = some_events(51)
    df = spark.createDataFrame(events + events[:20], "job_id string, seq long, ts timestamp, status string, error string")
    got = {(r.job_id, r.seq): (r.was, r.accepted) for r in jobs.replay(df).collect()}
    assert got == plain_replay(events) and {w for w, a in got.values() if a} == {None, "queued", "running"}
    assert jobs.replay(df.limit(0)).count() == 0


def lines(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f".{name}").write_text("\n".join(json.dumps(r, default=str) for r in rows) + "\n")
    (path / f".{name}").rename(path / name)


def test_job_stream(spark, tmp_path):
    """Events in order, late, illegal and twice, over three runs from one checkpoint; a job that never ends fails."""
    at = lambda s: f"2024-05-01T10:00:{s:02d}"
    e = lambda job, s, status, error=None: {"job_id": job, "ts": at(s), "status": status, "error": error}
    run = lambda limit=3_600_000: stateful.job_stream(spark, f"{tmp_path}/in", f"{tmp_path}/jobs", f"{tmp_path}/no", f"{tmp_path}/check", limit).awaitTermination()
    lines(tmp_path / "in", "1.json", [e("a", 2, "running"), e("a", 1, "queued"), e("b", 1, "queued"), e("b", 2, "succeeded"), e("c", 1, "queued"), e("d", 5, "running")])
    run()
    table = StateTable(spark, f"{tmp_path}/jobs", ["job_id"])
    assert {j: r["status"] for j, r in as_dict(table.read()).items()} == {"a": "running", "b": "queued", "c": "queued"}
    lines(tmp_path / "in", "2.json", [e("a", 9, "failed", "boom"), e("a", 1, "queued"), e("b", 4, "running"), e("c", 3, "running"), e("d", 1, "queued")])
    run()  # a restart: the states come from the checkpoint
    got = as_dict(table.read())
    assert {j: r["status"] for j, r in got.items()} == {"a": "failed", "b": "running", "c": "running", "d": "queued"}
    a = got["a"]
    assert a["error"] == "boom" and [str(a[k])[-8:] for k in ("created_at", "started_at", "finished_at")] == ["10:00:01", "10:00:02", "10:00:09"]
    lines(tmp_path / "in", "3.json", [e("a", 10, "succeeded"), e("b", 6, "succeeded")])
    run()
    rejected = {(r.job_id, r.status, r.was) for r in spark.read.parquet(f"{tmp_path}/no").collect()}
    assert rejected == {("b", "succeeded", "queued"), ("d", "running", None), ("a", "queued", "running"), ("a", "succeeded", "failed")}
    assert as_dict(table.read())["b"]["status"] == "succeeded"


def test_a_job_without_an_end_fails(spark, tmp_path):
    spark.conf.set(*stateful.STORE)
    e = lambda job, s, status: {"job_id": job, "ts": f"2024-05-01T10:00:{s:02d}", "status": status, "error": None}
    lines(tmp_path / "in", "1.json", [e("a", 1, "queued"), e("a", 2, "running"), e("b", 1, "queued"), e("b", 2, "running"), e("b", 3, "succeeded")])
    q = stateful.job_stream(spark, f"{tmp_path}/in", f"{tmp_path}/jobs", f"{tmp_path}/no", f"{tmp_path}/check", limit_ms=1000, available_now=False, seconds=1)
    try:
        deadline = time.time() + 45
        while time.time() < deadline and ("failed" not in {r.status for r in StateTable(spark, f"{tmp_path}/jobs", ["job_id"]).read().collect()} if (tmp_path / "jobs/_versions").exists() else True):
            time.sleep(1)
    finally:
        q.stop()
    got = as_dict(StateTable(spark, f"{tmp_path}/jobs", ["job_id"]).read())
    assert got["a"]["status"] == "failed" and "no end within" in got["a"]["error"] and got["b"]["status"] == "succeeded"


def tile_rows(page, boxes):
    """Tiles of a page on the default grid, an object in each: (tile_id, JSON)."""
    item = lambda b: [{"object_Bounding_Box": b, "classification_type": "valve", "confidence": 0.9}]
    return [{"page": page, "n_tiles": len(boxes), "tile_id": t, "value": json.dumps({"Image ID": page, "Tile ID": t, "OBJECT/COMPONENT": item(b)})} for t, b in boxes]


def test_pages_from_tiles_out_of_order_twice_and_late(spark, tmp_path):
    seam = [("Tile_001", [930, 410, 52, 36]), ("Tile_002", [34, 410, 52, 36]), ("Tile_007", [5, 5, 50, 50])]
    p1, p2, p3 = (tile_rows(p, seam) for p in ("p1", "p2", "p3"))
    run = lambda: stateful.page_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", S).awaitTermination()
    lines(tmp_path / "in", "1.json", [p1[2], p2[1], p1[0], p3[0]])
    run()
    lines(tmp_path / "in", "2.json", [p1[1], p2[1], p2[0]])  # p1 is whole; a tile of p2 comes twice
    run()  # a restart: what is held comes from the checkpoint
    lines(tmp_path / "in", "3.json", [p1[0], p2[2]])  # p1 is gone; p2 is whole
    run()
    got = spark.read.parquet(f"{tmp_path}/out/merged")
    assert {r.page for r in got.collect()} == {"p1", "p2"} and {r.status for r in got.collect()} == {"complete"}
    ann = annotations.parse(spark.createDataFrame([(r["page"], r["value"]) for r in p1 + p2], "page string, value string"))
    want = merging.merge(annotations.to_detections(ann, ("page",)), S)
    columns = ["page", "kind", "g0", "g1", "g2", "g3", "label", "confidence", "source_tiles", "members"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(got) == rows(want) and max(r.members for r in got.collect()) == 2
    assert [(r.page, r.tile_id) for r in spark.read.parquet(f"{tmp_path}/out/late").collect()] == [("p1", "Tile_001")]


def test_a_page_that_never_completes(spark, tmp_path):
    spark.conf.set(*stateful.STORE)
    lines(tmp_path / "in", "1.json", tile_rows("p", [("Tile_001", [1, 1, 40, 40]), ("Tile_002", [200, 1, 40, 40])])[:1])
    q = stateful.page_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", S, wait_ms=1000, available_now=False, seconds=1)
    try:
        deadline, found = time.time() + 45, []
        while time.time() < deadline and not found:
            time.sleep(1)
            try:
                found = spark.read.parquet(f"{tmp_path}/out/merged").where(F.col("page") == "p").collect()
            except Exception:
                continue
    finally:
        q.stop()
    assert [(r.status, r.source_tiles) for r in found] == [("incomplete", ["Tile_001"])]


def test_metrics_are_finite_and_names_may_meet(spark):
    df = spark.createDataFrame([({"a$": "1", "a%": "2", " b ": "NaN", "c": "Infinity", "d": "-Infinity", "e": "x", "f": None, "g": "1e-3"},), (None,), ({},)], "m map<string,string>")
    assert [r.m for r in df.select(jobs.clean_metrics(F.col("m")).alias("m")).collect()] == [{"a_": 2.0, "g": 0.001}, None, {}]


def test_request_rates_as_a_stream_drop_what_is_too_late(spark, tmp_path):
    """Windows close behind the watermark; a row for a closed window is dropped, one within the delay counts."""
    from sheetweave.streaming.detections import request_rates

    row = lambda minute, path="/v1/jobs": {"ts": f"2024-05-01T{10 + minute // 60}:{minute % 60:02d}:00", "path": path, "latency_ms": 10.0}

    def run():
        logs = spark.readStream.schema("ts timestamp, path string, latency_ms double").json(f"{tmp_path}/in")
        q = request_rates(logs).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        q.trigger(availableNow=True).start().awaitTermination()

    lines(tmp_path / "in", "1.json", [row(1), row(2), row(12)])
    run()
    lines(tmp_path / "in", "2.json", [row(4), row(30)])  # late, but within the ten minutes
    run()
    lines(tmp_path / "in", "3.json", [row(3), row(90)])  # its window has closed
    run()
    got = {str(r.window.start)[11:16]: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["10:00"] == 3 and got["10:10"] == 1
