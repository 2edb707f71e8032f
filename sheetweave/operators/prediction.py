"""Predictors as plug-ins over tiles, and the language-model decision for tile pairs."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave import workers
from sheetweave.functions.text import ascii_label
from sheetweave.operators import lines as line_votes
from sheetweave.operators import merging, predictors
from sheetweave.scratch import kept
from sheetweave.settings import Settings
from sheetweave.sources.state import StateTable

DETECTION = "path string, page int, tile_id string, kind string, item_idx int, g0 double, g1 double, g2 double, g3 double, label string, confidence double"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Suite:
    """A named set of predictors. build() gives {kind: predictor}; a predictor maps (image, least confidence) to
    (geometry, label, confidence)s and may have a version. A name and version stand for one suite on every worker."""

    name: str
    version: str
    build: Callable[[], dict]


def choose(kind: str, backend: str, known: dict[str, Callable], fallback: str):
    """The predictor of a backend. One that is named must build; "auto" takes the first that does and else the fallback."""
    if backend != "auto":
        if backend not in known:
            raise ValueError(f"no {kind} backend {backend!r}; known: {', '.join(sorted(known))}")
        return known[backend]()
    for name, make in known.items():
        if name != fallback:
            try:
                return make()
            except Exception as x:
                log.warning("%s backend %s does not build (%s: %s)", kind, name, type(x).__name__, x)
    return known[fallback]()


def default_suite(s: Settings, detectors: dict | None = None, lines: dict | None = None, readers: dict | None = None) -> Suite:
    """The suite of the settings' backends. Trained models are handed in as {name: build}; ink alone is the fallback."""
    choices = {
        "object": (s.detector_backend, {**(detectors or {}), "shapes": predictors.ShapeDetector}, "shapes"),
        "arrow": (s.line_backend, {**(lines or {}), "strokes": predictors.StrokeDetector}, "strokes"),
        "ocr": (s.ocr_backend, {**(readers or {}), "none": predictors.NoReader}, "none"),
    }
    if s.line_backend == "votes":  # found by Spark, not by a predictor: see infer()
        del choices["arrow"]
    version = ",".join(f"{kind}={backend}:{'+'.join(sorted(known))}" for kind, (backend, known, _) in choices.items())
    if s.line_backend == "votes":
        version += f",arrow={line_votes.VERSION}"
    return Suite("default", version, lambda: {kind: choose(kind, *c) for kind, c in choices.items()})


def versions(built: dict) -> dict[str, str]:
    return {kind: getattr(p, "version", "unknown") for kind, p in built.items()}


def infer(tiles: DataFrame, suite: Suite, s: Settings) -> DataFrame:
    """Detections of all tiles (path, page, tile_id, tw, th, bgr). A worker process builds a suite once for all its tasks. With
    the line backend "votes" arrows come from `operators.lines`, beside what the suite finds."""
    least = {"object": s.detector_conf, "ocr": s.ocr_conf, "arrow": s.line_conf}
    name, version, build = suite.name, suite.version, suite.build

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = workers.once((name, version), build)  # by reference to the module, so that the worker's own memory is meant
        for b in batches:
            rows = []
            for r in b.itertuples():
                image = np.frombuffer(r.bgr, np.uint8).reshape(r.th, r.tw, 3)
                for kind, predict in built.items():
                    rows += [(r.path, r.page, r.tile_id, kind, i, *map(float, g), label, c) for i, (g, label, c) in enumerate(predict(image, least[kind]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTION.split(", ")])

    found = tiles.mapInPandas(run, DETECTION)
    return found.unionByName(line_votes.detected(tiles, s.line_conf)) if s.line_backend == "votes" else found


def parse_decision(reply: str, kinds: dict[str, str]) -> tuple[list[tuple[list[str], str | None]], dict[str, str]]:
    """(merges, relabels) of a model's reply. Code fences are dropped; merges keep known ids once and in order, and need two
    or more of one kind; relabels need a known id and a label. Text that is no JSON object fails; ids that are no list are none."""
    data = json.loads(re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply))
    if not isinstance(data, dict):
        raise ValueError("reply is no object")
    merges = []
    for m in data.get("merges") or []:
        ids = m.get("ids") if isinstance(m, dict) else None
        known = [i for i in dict.fromkeys(ids if isinstance(ids, list) else []) if i in kinds]
        if len(known) > 1 and len({kinds[i] for i in known}) == 1:
            merges.append((known, m.get("label") or None))
    relabels = {r["id"]: r["label"] for r in data.get("relabels") or [] if isinstance(r, dict) and r.get("id") in kinds and r.get("label")}
    return merges, relabels


def prompt(version: str = "v1") -> str:
    """The instructions of a version; they are files, so that a result can name what it was asked."""
    return (resources.files("sheetweave") / "prompts" / f"seam_{version}.txt").read_text(encoding="utf-8")


def prompt_log(spark: SparkSession) -> DataFrame:
    """(version, sha256, text) of every prompt at hand, to be kept with the models' records."""
    rows = []
    for f in sorted((resources.files("sheetweave") / "prompts").iterdir(), key=lambda f: f.name):
        text = f.read_text(encoding="utf-8")
        rows.append((f.name.removeprefix("seam_").removesuffix(".txt"), hashlib.sha256(text.encode()).hexdigest(), text))
    return spark.createDataFrame(rows, "version string, sha256 string, text string")


@dataclass(frozen=True)
class ChatModel:
    """Asks a chat-completions service, without sampling. Anything but an answer in time raises."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0

    def __call__(self, instructions: str, payload: str) -> str:
        messages = [{"role": "system", "content": instructions}, {"role": "user", "content": payload}]
        body = json.dumps({"model": self.model, "temperature": 0, "messages": messages}).encode()
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as r:
            return json.loads(r.read())["choices"][0]["message"]["content"]


def merge_pages(
    detections: DataFrame, s: Settings, by: tuple = merging.BY, ask: Callable[[str, str], str] | None = None, memory: StateTable | None = None
) -> tuple[DataFrame, DataFrame]:
    """(merged rows, report) by the backend of the settings: geometry alone, or a language model that sees each seam.

    report: (by, pairs, merged_groups, llm_calls, llm_failures). Without a model's address its backend is an error; a call
    that fails leaves geometry's proposal for its pair. With a memory, what it holds is not asked again."""
    if s.merge_backend not in ("heuristic", "llm"):
        raise ValueError(f"no merge backend {s.merge_backend!r}")
    cands = kept(merging.candidates(detections, s, by))
    near = merging.seam_candidates(cands, s, by)
    none = F.lit(0).cast("long")
    if s.merge_backend == "heuristic":
        merged = kept(merging.merge(None, s, by, cands=cands))
        return merged, merging.report(merged, near, by).withColumns({"llm_calls": none, "llm_failures": none})
    if ask is None and not s.llm_url:
        raise ValueError("the llm merge backend needs SHEETWEAVE_LLM_URL")
    near, ask = kept(near), ask or ChatModel(s.llm_url, s.llm_model, s.llm_key, s.llm_timeout)
    if memory is None:
        decided = kept(decide_pairs(near, merging.match_edges(near, s, by), ask, by, s.prompt_version))
    else:
        from sheetweave.operators.decisions import decide_once

        decided = decide_once(near, merging.match_edges(near, s, by), ask, memory, by, s.prompt_version)
    real = decided.where("src IS NOT NULL")
    merged = kept(merging.merge(None, s, by, decisions=real.where("kind <> 'call'"), labels=merge_labels(real.where("kind <> 'call'"), by), cands=cands))
    calls = decided.where("kind = 'call'").groupBy(*by).agg(F.count("*").alias("llm_calls"), F.count_if("failed").alias("llm_failures"))
    report = merging.report(merged, near, by).join(calls, [*by], "left")
    return merged, report.withColumns({c: F.coalesce(F.col(c), none) for c in ("llm_calls", "llm_failures")})


def decide_pairs(near: DataFrame, hints: DataFrame, ask: Callable[[str, str], str], by: tuple = merging.BY, version: str = "v1") -> DataFrame:
    """(by, pair_ord, kind, src, dst, label, failed): each page's seams put to ask(instructions, payload), in pair order, as
    a relabel changes what later seams are told. A call or reply that fails leaves the hints of its pair. Each call is a row
    of its own too, of kind 'call'."""
    instructions = prompt(version)

    def shown(rows: pd.DataFrame, names: dict[str, str]) -> list[dict]:
        """Geometry to a tenth of a pixel, confidence to three digits and only where there is one."""
        out = []
        for r in rows.itertuples():
            item = {"id": r.uid, "kind": r.kind, "geometry": [round(v, 1) for v in (r.g0, r.g1, r.g2, r.g3)], "label": names[r.uid]}
            out.append(item if pd.isna(r.confidence) else {**item, "confidence": round(r.confidence, 3)})
        return out

    def page(key, items: pd.DataFrame, proposed: pd.DataFrame) -> pd.DataFrame:
        out, names = [], dict(zip(items["uid"], items["label"]))
        for pair, own in items.groupby("pair_ord", sort=True):
            sides = [own[own["side"] == x] for x in "ab"]
            if not len(sides[0]) or not len(sides[1]):
                continue
            hint, one = proposed[proposed["pair_ord"] == pair], own.iloc[0]
            kinds = dict(zip(own["uid"], own["kind"]))
            payload = {
                "seam": [round(float(one[f"o{i}"]), 1) for i in range(4)], "orientation": one["orientation"],
                "tile_a": shown(sides[0], names), "tile_b": shown(sides[1], names), "hints": hint[["src", "dst"]].values.tolist(),
            }
            try:
                merges, relabels = parse_decision(ask(instructions, json.dumps(payload, ensure_ascii=False)), kinds)
                failed = False
                for ids, label in merges:
                    out += [(*key, pair, kinds[ids[0]], ids[0], other, label, False) for other in ids[1:]]
                for uid, label in relabels.items():
                    names[uid] = label
                    out.append((*key, pair, kinds[uid], uid, uid, label, False))
            except Exception as x:  # whatever fails at the model leaves geometry's proposal
                log.warning("no decision for pair %s: %s: %s", pair, type(x).__name__, x)
                failed = True
                out += [(*key, pair, r.kind, r.src, r.dst, None, True) for r in hint.itertuples()]
            out.append((*key, pair, "call", None, None, None, failed))
        return pd.DataFrame(out, columns=[*by, "pair_ord", "kind", "src", "dst", "label", "failed"])

    schema = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in by) + ", pair_ord int, kind string, src string, dst string, label string, failed boolean"
    # New names for the columns: hints are made from near, and the two must not be taken for one.
    hints = hints.toDF(*[f"h_{c}" for c in hints.columns]).toDF(*hints.columns)
    return near.groupBy(*by).cogroup(hints.groupBy(*by)).applyInPandas(page, schema)


def merge_labels(decisions: DataFrame, by: tuple = merging.BY) -> DataFrame:
    """(by, uid, label): the label of each id; the last merging pair wins over earlier ones, any merge over a relabel."""
    merges = decisions.where("src <> dst AND label IS NOT NULL").select(
        *by, F.explode(F.array("src", "dst")).alias("uid"), "label", (F.col("pair_ord") + 1_000_000_000).alias("rank")
    )
    alone = decisions.where("src = dst").select(*by, F.col("src").alias("uid"), "label", (-F.col("pair_ord")).alias("rank"))
    return merges.unionByName(alone).groupBy(*by, "uid").agg(F.max_by("label", "rank").alias("label"))


def draw_commands(merged: DataFrame) -> DataFrame:
    """What an overlay draws: boxes for objects and texts, lines for arrows, each with an ASCII caption."""
    shape = F.when(F.col("kind") == "arrow", "line").otherwise("box")
    caption = ascii_label(F.when(F.col("kind") == "ocr", F.substring("label", 1, 40)).otherwise(F.col("label")))
    return merged.withColumn("shape", shape).withColumn("caption", caption)
