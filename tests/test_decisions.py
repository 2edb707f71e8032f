"""Seam decisions asked once: memory over runs and pages, failures, relabels in order, replies of every shape."""

import json
import random

from sheetweave.operators import decisions, merging, prediction
from sheetweave.settings import Settings
from sheetweave.sources.state import StateTable
from sheetweave.streaming.detections import SCHEMA

S = Settings(merge_backend="llm")


class Model:
    """Answers from a table by ids, and writes every call to a file of its own; fails on ids that it is told to."""

    def __init__(self, folder, replies=None, fails=()):
        self.folder, self.replies, self.fails = str(folder), replies or {}, fails

    def __call__(self, instructions, payload):
        import os
        import uuid

        p = json.loads(payload)
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(payload)
        ids = sorted(i["id"] for i in p["tile_a"] + p["tile_b"])
        if any(i in self.fails for i in ids):
            raise OSError("down")
        own = [self.replies[i] for i in ids if i in self.replies]
        return own[0] if own else json.dumps({"merges": [{"ids": h, "label": None} for h in p["hints"]], "relabels": []})


def calls(folder):
    return [json.loads(f.read_text()) for f in folder.iterdir()]


def some(seed, pages):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for n, tile in enumerate(("Tile_001", "Tile_002", "Tile_006", "Tile_007")):
            for i in range(rng.randrange(4)):
                x, y = (rng.choice([0.0, 900.0, 930.0, 980.0]) for _ in range(2))
                rows.append((p, n, tile, "object", i, x, y, 40.0 + 10 * rng.randrange(3), 60.0, rng.choice("ab"), rng.choice([None, 0.5, 0.812345])))
    return rows


def near_and_hints(spark, rows):
    near = merging.seam_candidates(merging.candidates(spark.createDataFrame(rows, SCHEMA), S), S)
    return near, merging.match_edges(near, S)


def as_rows(df):
    return sorted(map(str, df.select("page", "pair_ord", "kind", "src", "dst", "label", "failed").collect()))


def test_two_runs_make_one_call_for_each_seam(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = some(81, 3)
    rows += [(p + 10, *r[1:]) for p, r in [(r[0], r) for r in rows]]  # pages like the first ones
    near, hints = near_and_hints(spark, rows)
    memory = StateTable(spark, f"{tmp_path}/memory", ["key"], 4)
    first = decisions.decide_once(near, hints, Model(tmp_path / "calls"), memory)
    asked = calls(tmp_path / "calls")
    seams = merging.active_pairs(near).count()
    assert len({json.dumps(a, sort_keys=True) for a in asked}) == len(asked) <= seams // 2 and first.where("kind = 'call'").count() == seams
    again = decisions.decide_once(near, hints, Model(tmp_path / "calls", fails=[r.uid for r in near.select("uid").collect()]), memory)
    assert len(calls(tmp_path / "calls")) == len(asked) and as_rows(again) == as_rows(first)  # replayed without a service
    want = prediction.decide_pairs(near, hints, Model(tmp_path / "calls"))
    key = lambda df: {(r.page, r.pair_ord, *sorted((r.src, r.dst))) for r in df.where("kind <> 'call'").collect()}
    assert key(first) == key(want)


def test_calls_that_fail_leave_the_hints_and_are_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [(1, 0, "Tile_001", "object", 0, 930.0, 410.0, 52.0, 36.0, "valve", 0.9), (1, 1, "Tile_002", "object", 0, 34.0, 410.0, 52.0, 36.0, "valve", 0.9)]
    near, hints = near_and_hints(spark, rows)
    memory = StateTable(spark, f"{tmp_path}/memory", ["key"], 4)
    down = decisions.decide_once(near, hints, Model(tmp_path / "calls", fails=["Tile_001:object:0"]), memory).collect()
    assert sorted((r.kind, r.src, r.failed) for r in down if r.kind != "call") == [("object", "Tile_001:object:0", True)] and all(r.failed for r in down)
    up = decisions.decide_once(near, hints, Model(tmp_path / "calls"), memory).collect()
    assert not any(r.failed for r in up) and len(calls(tmp_path / "calls")) == 2
    merged, report = prediction.merge_pages(spark.createDataFrame(rows, SCHEMA), S, ask=Model(tmp_path / "calls"), memory=memory)
    assert [r.members for r in merged.collect()] == [2] and len(calls(tmp_path / "calls")) == 2
    assert [(r.llm_calls, r.llm_failures) for r in report.collect()] == [(1, 0)]
    assert decisions.decide_once(near.limit(0), hints.limit(0), Model(tmp_path / "calls"), memory).count() == 0


def test_a_relabel_reaches_later_seams_of_the_item(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [(1, n, t, "object", 0, x, y, 60.0, 60.0, "old", 0.9) for n, t, x, y in ((0, "Tile_001", 930.0, 930.0), (1, "Tile_002", 34.0, 930.0), (5, "Tile_006", 930.0, 34.0))]
    near, hints = near_and_hints(spark, rows)
    reply = {"Tile_001:object:0": json.dumps({"merges": [], "relabels": [{"id": "Tile_001:object:0", "label": "new"}, {"id": "nobody", "label": "x"}]})}
    got = decisions.decide_once(near, hints, Model(tmp_path / "calls", reply), StateTable(spark, f"{tmp_path}/m", ["key"], 4))
    labels = {tuple(sorted((i["id"][:8], i["label"]) for i in p["tile_a"] + p["tile_b"])) for p in calls(tmp_path / "calls")}
    assert (("Tile_001", "old"), ("Tile_002", "old")) in labels and (("Tile_001", "new"), ("Tile_006", "old")) in labels
    assert {(r.src, r.dst, r.label) for r in got.where("src = dst").collect()} == {("Tile_001:object:0", "Tile_001:object:0", "new")}


def test_rounds_put_answers_beside_those_of_earlier_rounds(spark, tmp_path):
    """One bucket, so a round that rewrote what it touches would write the answers of the rounds before again."""
    (tmp_path / "calls").mkdir()
    rows = some(7, 4)
    # A page whose second seam is told what the only seam of another page is told: asked in the first round, looked up in the second.
    three = [(n, t, "object", 0, x, y, 60.0, 60.0, "old", 0.9) for n, t, x, y in ((0, "Tile_001", 930.0, 930.0), (1, "Tile_002", 34.0, 930.0), (5, "Tile_006", 930.0, 34.0))]
    rows += [(50, *r) for r in three] + [(51, *three[0]), (51, *three[2])]
    near, hints = near_and_hints(spark, rows)
    levels = decisions._levels(decisions._active(near, ("page",)), ("page",))
    assert {(r.page, r.level) for r in levels.where("page > 49").collect()} >= {(50, 1), (50, 2), (51, 1)}
    memory = StateTable(spark, f"{tmp_path}/memory", ["key"], 1)
    got = decisions.decide_once(near, hints, Model(tmp_path / "calls"), memory)
    asked = calls(tmp_path / "calls")
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/memory/data").count()
    assert len({json.dumps(a, sort_keys=True) for a in asked}) == len(asked) == memory.read().count() == written
    assert len(memory.versions()) > 1 and got.where("kind = 'call'").count() == merging.active_pairs(near).count() > len(asked)
    want = prediction.decide_pairs(near, hints, Model(tmp_path / "calls"))
    key = lambda df: {(r.page, r.pair_ord, *sorted((r.src, r.dst))) for r in df.where("kind <> 'call'").collect()}
    assert key(got) == key(want)


def test_replies_of_every_shape(spark):
    kinds = {"a": "object", "b": "object", "c": "ocr", "d": "object"}
    replies = [
        '{"merges": [{"ids": ["a", "b"], "label": "L"}], "relabels": []}', '```json\n{"merges": [{"ids": ["b", "x", "a", "b", "d"], "label": ""}]}\n```', '{"merges": [{"ids": ["a", "c"]}]}',
        '{"merges": [{"ids": "ab"}, {"ids": ["a"]}, "odd", {"ids": null}], "relabels": [{"id": "c", "label": "T"}, {"id": "c", "label": "U"}, {"id": "z", "label": "V"}, {"id": "a", "label": ""}]}',
        "{}", "no json", "[1]", "null", None, '{"merges": null, "relabels": null}', '{"merges": [{"ids": ["a", null, "b"]}]}',
    ]
    rows = [(n, 0, kinds, [("a", "b", "object")], r) for n, r in enumerate(replies)]
    got = {}
    schema = "page int, pair_ord int, kinds map<string,string>, hints array<struct<src: string, dst: string, kind: string>>, reply string"
    for r in decisions.checked(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.page, []).append((r.kind, r.src, r.dst, r.label, r.failed))
    for n, reply in enumerate(replies):
        try:
            merges, relabels = prediction.parse_decision(reply, kinds)
            want = [(kinds[i[0]], i[0], other, label, False) for i, label in merges for other in i[1:]] + [(kinds[u], u, u, label, False) for u, label in relabels.items()] + [("call", None, None, None, False)]
        except Exception:
            want = [("object", "a", "b", None, True), ("call", None, None, None, True)]
        assert sorted(got[n], key=str) == sorted(want, key=str), reply


def test_levels_are_those_of_plain_python_and_no_python_of_the_query(spark):
    rng = random.Random(5)
    rows = [(page, rng.randrange(1, 4 + page), f"u{rng.randrange(9)}") for page in range(12) for _ in range(rng.randrange(1, 30))]
    want = {}
    for page in range(12):
        behind = {}
        for pair in sorted({p for g, p, _ in rows if g == page}):
            uids = {u for g, p, u in rows if (g, p) == (page, pair)}
            want[page, pair] = 1 + max(behind.get(u, 0) for u in uids)
            behind.update(dict.fromkeys(uids, want[page, pair]))
    got = decisions._levels(spark.createDataFrame(rows, "page int, pair_ord int, uid string"), ("page",))
    assert {(r.page, r.pair_ord): r.level for r in got.collect()} == want and max(want.values()) > 5
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
