"""Seam decisions of a language model, each asked once.

What a seam is told (its payload) has a hash, and answers are remembered by it in a state table, so only payloads that
were never answered are asked: not those of an earlier run, nor one that two pages share. Payloads, the search of what is
not yet known, and the check of replies are relational; only the calls themselves are Python, a few at a time in each task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions.numbers import exact_round
from sheetweave.operators import merging
from sheetweave.operators.prediction import prompt
from sheetweave.scratch import kept, kept_at, scope
from sheetweave.sources.state import StateTable

#: Calls that a task has under way at once, and payloads that a task is given: what a lost task asks again, at most.
AT_ONCE, PER_TASK = 8, 32
REPLY = "merges array<struct<ids: array<string>, label: string>>, relabels array<struct<id: string, label: string>>"


def payloads(near: DataFrame, hints: DataFrame, by: tuple = merging.BY, levels: DataFrame | None = None) -> DataFrame:
    """(by, pair_ord, kinds, hints, payload) of each pair with items on both sides. near: seam candidates; hints: match edges.

    The payload holds the seam, both sides in input order with geometry to a tenth of a pixel and confidence to three
    digits, and what geometry proposes. kinds maps the ids that a reply may name; a page's seam is one row. With levels
    (by, pair_ord, level) the pairs are those that have one, and it is a column too. Items, edges and levels of a pair meet in
    one grouping."""
    keys = [*by, "pair_ord"]
    confidence = exact_round(F.col("confidence"), 3)
    geometry = F.array(*[exact_round(F.col(f"g{i}"), 1) for i in range(4)])
    item = F.struct("ord", F.struct(F.col("uid").alias("id"), "kind", geometry.alias("geometry"), "label", confidence.alias("confidence")).alias("i"))
    over = F.struct(*[f"o{i}" for i in range(4)], "orientation").alias("over")
    rows = near.select(*keys, *[F.when(F.col("side") == s, item).alias(s) for s in "ab"], over).unionByName(
        hints.select(*keys, F.struct("src", "dst", "kind").alias("edge")), allowMissingColumns=True
    )
    if levels is not None:
        rows = rows.unionByName(levels.select(*keys, "level"), allowMissingColumns=True)
    side = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda x: x["i"]).alias(f"tile_{s}")
    level = [] if levels is None else [F.max("level").alias("level")]
    pairs = rows.groupBy(*keys).agg(side("a"), side("b"), F.first("over", ignorenulls=True).alias("over"), F.array_sort(F.collect_list("edge")).alias("hints"), *level)
    pairs = pairs.where("size(tile_a) > 0 AND size(tile_b) > 0" + (" AND level IS NOT NULL" if level else ""))
    seam = F.array(*[exact_round(F.col(f"over.o{i}"), 1) for i in range(4)]).alias("seam")
    told = F.struct(seam, "over.orientation", "tile_a", "tile_b", F.transform("hints", lambda h: F.array(h["src"], h["dst"])).alias("hints"))
    kinds = F.map_from_entries(F.array_distinct(F.transform(F.concat("tile_a", "tile_b"), lambda x: F.struct(x["id"].alias("key"), x["kind"].alias("value")))))
    return pairs.select(*keys, *["level"] * len(level), kinds.alias("kinds"), "hints", F.to_json(told).alias("payload"))


def _asked(unseen: DataFrame, ask: Callable[[str, str], str], instructions: str, per_task: int, most: int) -> DataFrame:
    """(key, reply, error) of every different payload (key, payload) of `most` rows. A call that fails is a row without a reply."""

    def one(payload: str) -> tuple[str | None, str | None]:
        try:
            return ask(instructions, payload), None
        except Exception as x:  # whatever fails at the model is the caller's to judge
            return None, f"{type(x).__name__}: {x}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in batches:
                asked, replies = b["payload"].tolist(), [(None, None)] * len(b)
                places = iter(range(len(b)))  # each thread takes the next, so a slow call holds none up

                def take(_: int) -> None:
                    for i in places:
                        replies[i] = one(asked[i])

                list(pool.map(take, range(AT_ONCE)))
                yield pd.DataFrame({"key": b["key"], "reply": [r for r, _ in replies], "error": [e for _, e in replies]})

    n = max(1, -(-most // per_task))
    # Of one key one payload: they are dealt by key already.
    return unseen.repartition(n, "key").dropDuplicates(["key"]).mapInPandas(run, "key string, reply string, error string")


def keyed(told: DataFrame, version: str = "v1") -> DataFrame:
    """told (.., payload) with key, that of the instructions and the payload."""
    return told.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(version), F.lit(prompt(version)), "payload"), 256))


def answered(
    told: DataFrame, ask: Callable[[str, str], str], memory: StateTable, version: str = "v1", per_task: int = PER_TASK, rows: int | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """told (.., payload, key) with reply, from memory where it has one, asked and remembered otherwise; null where the call failed.

    What was asked is written before it is used, so a failure later on asks nothing twice, and it is put beside what the memory
    holds, which stays as it is. Failed calls are not remembered. Who knows that the memory can only hold some of the keys gives
    them as seen (key), and the number of rows told."""
    unseen, found = told.select("key", "payload"), None
    if memory.versions() and (rows is None or seen is not None):
        looked_up = told.select("key") if rows is None else told.join(seen, "key", "left_semi").select("key")
        found = kept(memory.read().select("key", "reply").join(looked_up, "key", "left_semi"))
        unseen = unseen.join(found.select("key"), "key", "left_anti")
    if rows is None:
        unseen = kept(unseen)
    new = kept(_asked(unseen, ask, prompt(version), per_task, unseen.count() if rows is None else rows))
    replies = new.where("reply IS NOT NULL").select("key", "reply")
    memory.append(replies.withColumn("asked_at", F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")))
    return told.join(replies if found is None else replies.unionByName(found), "key", "left").drop("key")


def checked(replied: DataFrame, by: tuple = merging.BY) -> DataFrame:
    """(by, pair_ord, kind, src, dst, label, failed) of rows (by, pair_ord, kinds, hints, reply): what a reply may decide.

    Code fences are dropped. A merge keeps known ids, each once and in order, and needs two or more of one kind; it ties
    them to the first. A relabel (src = dst) needs a known id and a label; of several for one id the last counts. No reply,
    or one that is no JSON object, leaves the hints. Each pair is also a row of kind 'call'."""
    keys = [*by, "pair_ord"]
    bare = F.regexp_replace("reply", r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT"), F.lit(False))
    some = lambda name: F.coalesce(F.col(f"r.{name}"), F.array())
    known = lambda i: F.map_contains_key("kinds", F.coalesce(i, F.lit("")))
    kind = lambda i: F.element_at("kinds", i)
    row = lambda kind, src, dst, label, failed: F.struct(
        kind.alias("kind"), src.alias("src"), dst.alias("dst"), label.cast("string").alias("label"), failed.alias("failed")
    )
    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = replied.withColumn("failed", ~is_object).withColumn("r", F.when(~F.col("failed"), F.from_json(bare, REPLY)))
    named = F.transform(some("merges"), lambda x: F.struct(
        F.filter(F.array_distinct(F.coalesce(x["ids"], F.array().cast("array<string>"))), known).alias("ids"), F.when(x["label"] != "", x["label"]).alias("label")
    ))
    given = F.filter(some("relabels"), lambda x: (x["label"] != "") & known(x["id"]))
    rows = rows.withColumns({"m": named, "l": given})
    merges = F.filter("m", lambda x: (F.size(x["ids"]) > 1) & (F.size(F.array_distinct(F.transform(x["ids"], kind))) == 1))
    ties = lambda x: F.transform(F.slice(x["ids"], F.lit(2), F.size(x["ids"])), lambda i: row(kind(x["ids"][0]), x["ids"][0], i, x["label"], no))
    last = F.filter("l", lambda x, i: ~F.exists(F.slice("l", i + 2, F.size("l")), lambda y: y["id"] == x["id"]))
    left = F.when(F.col("failed"), F.transform("hints", lambda h: row(h["kind"], h["src"], h["dst"], none, F.lit(True)))).otherwise(F.array())
    call = F.array(row(F.lit("call"), none, none, none, F.col("failed")))
    alone = F.transform(last, lambda x: row(kind(x["id"]), x["id"], x["id"], x["label"], no))
    out = F.concat(F.flatten(F.transform(merges, ties)), alone, left, call)
    return rows.select(*keys, F.explode(out).alias("d")).select(*keys, "d.*")


def _levels(items: DataFrame, by: tuple) -> DataFrame:
    """(by, pair_ord, level): a seam's place in the longest chain of a page's seams, in pair order, that share items. A page's seams are few.

    Of the seams of an item each follows the one before it; a chain that leaves one out is never longer. So a page is an array
    of its seams and of what each follows, however many items it has. All is dealt by page once."""
    seams_of = Window.partitionBy(*by, "uid").orderBy("pair_ord")
    linked = items.select(*by, "pair_ord", "uid").repartition(*by).withColumn("after", F.nullif(F.lag("pair_ord").over(seams_of), F.col("pair_ord")))
    pages = linked.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("pair_ord", "after"))).alias("seams"))
    none = F.array().cast(f"array<struct<pair_ord: {items.schema['pair_ord'].dataType.simpleString()}, level: int>>")

    def placed(done, x):
        before = F.transform(F.filter(done, lambda d: d["pair_ord"] == x["after"]), lambda d: d["level"])  # none for the first of an item
        return F.array_append(done, F.struct(x["pair_ord"].alias("pair_ord"), (F.coalesce(F.array_max(before), F.lit(0)) + 1).alias("level")))

    each = pages.select(*by, F.explode(F.aggregate("seams", none, placed)).alias("l"))
    return each.groupBy(*by, F.col("l.pair_ord").alias("pair_ord")).agg(F.max("l.level").alias("level"))


def _active(near: DataFrame, by: tuple) -> DataFrame:
    """(by, pair_ord, uid) of near, where the pair has items on both sides. Dealt by page."""
    pair = Window.partitionBy(*by, "pair_ord")
    both = {s: F.max(F.col("side") == s).over(pair) for s in "ab"}
    return near.select(*by, "pair_ord", "side", "uid").repartition(*by).withColumns(both).where("a AND b").select(*by, "pair_ord", "uid")


def decide_once(
    near: DataFrame, hints: DataFrame, ask: Callable[[str, str], str], memory: StateTable, by: tuple = merging.BY, version: str = "v1", per_task: int = PER_TASK
) -> DataFrame:
    """checked() decisions of all seams, in the order of a page's pairs where it matters: a relabel changes what later seams
    of the same item are told. A round asks the seams of all pages that no undecided earlier one shares an item with, so
    rounds are as many as the longest chain of seams that share items.

    What seams are told is worked out once, and again only for those that a relabel has changed. What a memory can hold of
    a round is looked up in it: as long as it was empty and nothing was relabelled, what an earlier round was told too."""
    keys, rounds, given, said = [*by, "pair_ord"], [], [], None
    filled = bool(memory.versions())
    with scope(near.sparkSession) as wanted:
        levels = kept(_levels(_active(near, by), by))
        # Sorted, so that a round opens the parts of its own level and not the whole table again.
        told = kept(keyed(payloads(near, hints, by, levels), version).sortWithinPartitions("level"))
        deep = {r["level"]: r["n"] for r in told.groupBy("level").agg(F.count("*").alias("n")).collect()}  # as many rows as rounds
        again = kept(told.groupBy("key").agg(F.min("level").alias("lo"), F.max("level").alias("hi")).where("lo < hi").select("key", "lo"))
        some_again = not filled and len(deep) > 1 and not again.isEmpty()
        for level in sorted(deep):
            now, of_level = told.where(F.col("level") == level), levels.where(F.col("level") == level)
            if said is not None:
                items = near.join(of_level.select(*keys), keys, "left_semi")
                changed = kept(items.join(said, [*by, "uid"], "left_semi").select(*keys).distinct())
                items = items.join(changed, keys, "left_semi").join(said, [*by, "uid"], "left").withColumn("label", F.coalesce("_label", "label"))
                other = payloads(items.drop("_label"), hints.join(changed, keys, "left_semi"), by, of_level)
                now = now.join(changed, keys, "left_anti").unionByName(keyed(other, version))
            known = {} if filled or said is not None else {"rows": deep[level], "seen": again.where(F.col("lo") < level).select("key") if some_again else None}
            out, path = kept_at(checked(answered(now, ask, memory, version, per_task, **known), by))
            wanted.append(path)
            rounds.append(out)
            labels = out.where("src = dst")
            if level < max(deep) and not labels.isEmpty():
                given.append(labels)
                said = reduce(DataFrame.unionByName, given).groupBy(*by, F.col("src").alias("uid")).agg(F.max_by("label", "pair_ord").alias("_label"))
    if not rounds:
        types = [*[f"{c} {near.schema[c].dataType.simpleString()}" for c in keys], "kind string, src string, dst string, label string, failed boolean"]
        return near.sparkSession.createDataFrame([], ", ".join(types))
    return reduce(DataFrame.unionByName, rounds)
