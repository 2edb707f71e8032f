"""Detections of overlapping tiles merged into one list per page.

candidates -> seam pairs -> match edges -> components -> fused rows. `by` names the columns that tell pages apart. Tiles are
those of the settings' grid, or a layout: by..., idx, tile_id, tx, ty, tw, th (operators/layouts.py), each page with its own.
Detections: by..., tile_idx, tile_id, kind (object, ocr, arrow), item_idx, g0..g3 (tile pixels), label, confidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.functions.text import join_fragments
from sheetweave.operators import layouts
from sheetweave.operators.tiling import tile_grid, tile_pairs
from sheetweave.scratch import kept, kept_at, remove
from sheetweave.settings import Settings

BY = ("page",)
KINDS = ("object", "ocr", "arrow")
#: Pixels along a seam that share a key of the matching join.
BAND = 256
#: Edges of one page whose components one task finds; larger pages take rounds over the cluster.
PAGE_EDGES = 200_000


def apply_thresholds(detections: DataFrame, s: Settings) -> DataFrame:
    """Keep confidences at or above their kind's threshold; a null confidence (ground truth) passes."""
    least = F.when(F.col("kind") == "object", s.detector_conf).when(F.col("kind") == "arrow", s.line_conf).otherwise(s.ocr_conf)
    return detections.where(F.col("confidence").isNull() | (F.col("confidence") >= least))


def candidates(detections: DataFrame, s: Settings, by: tuple = BY, layout: DataFrame | None = None) -> DataFrame:
    """Detections in canvas pixels with uid, ord (place in the input) and bounding box b0..b3. tx, ty are those of the grid or layout.

    ord leaves 2^40 places for each tile and kind."""
    place = [F.col("idx").alias("_idx"), F.col("tx").cast("double").alias("_x"), F.col("ty").cast("double").alias("_y")]
    if layout is None:
        at = F.broadcast(tile_grid(detections.sparkSession, s).select("tile_id", *place))  # as many rows as the grid has tiles
        rows = detections.drop("tile_idx").join(at, "tile_id")
    else:
        rows = detections.drop("tile_idx").join(layout.select(*by, "tile_id", *place), [*by, "tile_id"])
    g, arrow = G.quad("g"), F.col("kind") == "arrow"
    start = (g[0] + F.col("_x"), g[1] + F.col("_y"))
    end = [F.when(arrow, v + F.col(c)).otherwise(v) for v, c in ((g[2], "_x"), (g[3], "_y"))]
    rank = F.when(arrow, 2).when(F.col("kind") == "ocr", 1).otherwise(0)
    rows = rows.withColumns({
        **{f"g{i}": v for i, v in enumerate((*start, *end))},
        "uid": F.concat_ws(":", "tile_id", "kind", F.col("item_idx").cast("string")),
        "ord": F.shiftleft(F.col("_idx").cast("long") * 3 + rank, 40) + F.col("item_idx"),
        "tile_idx": F.col("_idx"),
    }).drop("_idx", "_x", "_y")
    box = G.segment_box(G.quad("g"))
    return rows.withColumns({f"b{i}": F.when(arrow, v).otherwise(F.col(f"g{i}")) for i, v in enumerate(box)})


def seam_candidates(cands: DataFrame, s: Settings, by: tuple = BY, layout: DataFrame | None = None) -> DataFrame:
    """Candidates near the seam of each pair their tile is in: side a or b, pair columns kept. The pairs of the grid are a few rows."""
    pairs = tile_pairs(tile_grid(cands.sparkSession, s), s.seam_margin) if layout is None else layouts.pairs(layout, s.seam_margin, by)
    sides = pairs.withColumn("tile_id", F.explode(F.array("a", "b"))).withColumn("side", F.when(F.col("tile_id") == F.col("a"), "a").otherwise("b"))
    b, seam = G.quad("b"), G.quad("s")
    wide = (b[0] - 1, b[1] - 1, b[2] + 2, b[3] + 2)
    sides = sides.drop("a", "b")
    met = cands.join(F.broadcast(sides), "tile_id") if layout is None else cands.join(sides, [*by, "tile_id"])
    return met.where(G.overlaps(wide, seam))


def active_pairs(near: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, pair_ord) with candidates, of any kind, on both sides."""
    return near.groupBy(*by, "pair_ord").agg(
        F.max(F.col("side") == "a").alias("l"), F.max(F.col("side") == "b").alias("r")
    ).where("l AND r").select(*by, "pair_ord")


def _cut(over: G.Quad) -> dict[str, Column]:
    """Corners and area of a box, of it within the overlap widened by 2 px, and whether anything is left there."""
    b = G.quad("g")
    x, y, x2, y2 = G.corners(b)
    wide = G.corners((over[0] - 2, over[1] - 2, over[2] + 4, over[3] + 4))
    c = (F.greatest(x, wide[0]), F.greatest(y, wide[1]), F.least(x2, wide[2]), F.least(y2, wide[3]))
    return {
        **dict(zip(("x", "y", "x2", "y2"), (x, y, x2, y2))), "area": G.area(b),
        **dict(zip(("cx", "cy", "cx2", "cy2"), c)), "left": (c[2] > c[0]) & (c[3] > c[1]), "cut_area": (c[2] - c[0]) * (c[3] - c[1]),
    }


def _shares(a: dict, b: dict, names: tuple[str, ...], area: str, least: float) -> Column:
    """Intersection over union of two boxes, given by the names of their corners and area, of `least` or more."""
    x, y, x2, y2 = names
    w, h = F.least(a[x2], b[x2]) - F.greatest(a[x], b[x]), F.least(a[y2], b[y2]) - F.greatest(a[y], b[y])
    shared = w * h
    return (w > 0) & (h > 0) & (shared / (a[area] + b[area] - shared + F.lit(G.EPS)) >= least)


def _object_views(a: dict, b: dict, s: Settings) -> tuple[Column, Column]:
    """Whether two objects share enough of what the overlap shows of them, and of all of them."""
    cut = a["left"] & b["left"] & _shares(a, b, ("cx", "cy", "cx2", "cy2"), "cut_area", s.overlap_iou)
    return cut, _shares(a, b, ("x", "y", "x2", "y2"), "area", s.overlap_iou)


def _same_object(a: dict, b: dict, s: Settings) -> Column:
    cut, whole = _object_views(a, b, s)
    return cut | whole


def _same_text(a: dict, b: dict, s: Settings) -> Column:
    cut = a["left"] & b["left"] & _shares(a, b, ("cx", "cy", "cx2", "cy2"), "cut_area", s.overlap_iou)
    low, high = F.least(a["h"], b["h"]), F.greatest(a["h"], b["h"], F.lit(1e-6))
    level = F.abs((a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2)) <= 0.5 * low
    gap = F.greatest(b["x"] - a["x2"], a["x"] - b["x2"])
    return cut | ((a["orientation"] == "vertical") & level & (low / high >= 0.6) & (gap <= s.endpoint_tol))


def _same_angle(a: dict, b: dict, s: Settings) -> Column:
    """Near angle. The rest of the rule: _same_line()."""
    return G.angle_difference(a["angle"], b["angle"]) <= s.angle_tol_deg


def _same_line(met: DataFrame, a: dict, b: dict, s: Settings) -> DataFrame:
    """Rows of met with both ends of b near the line of a, which is the measure, and segments whose G.segment_gap() is within reach.

    Each step comes out of an explode of one element, so it is worked out once and only for rows that passed the one before.
    As the join's condition all of it makes a method of more than 8,000 bytes, which the JVM does not compile."""
    p, q = ([e[f"g{i}"] for i in range(4)] for e in (a, b))
    off = F.greatest(G.line_distance(q[0], q[1], p), G.line_distance(q[2], q[3], p))
    met = met.withColumn("_off", F.explode(F.array(off))).where(F.col("_off") <= s.line_dist_tol)
    ends = G.end_points(p, q)
    met = met.withColumn("_at", F.explode(F.array(F.struct(*[G.nearest_share(*e).alias(f"t{i}") for i, e in enumerate(ends)]))))
    met = met.withColumn("_gap", F.explode(F.array(F.least(*[G.share_distance(*e, F.col(f"_at.t{i}")) for i, e in enumerate(ends)]))))
    return met.where(F.col("_gap") <= s.endpoint_tol)


def _spans(ends: DataFrame) -> DataFrame:
    """ends with each stretch (lo, hi) of the seam that an object takes: cut at the overlap, and whole; one row where they are the same."""
    k = {n: F.col(f"k.{n}") for n in ("orientation", "left", "cx", "cy", "cx2", "cy2", "lo", "hi")}
    at, to = (F.when(k["orientation"] == "vertical", k[v]).otherwise(k[h]) for v, h in (("cy", "cx"), ("cy2", "cx2")))
    span = lambda lo, hi, cut, whole: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(cut).alias("cut"), F.lit(whole).alias("whole"))
    lo, hi = k["lo"], k["hi"]
    found = F.when(~k["left"], F.array(span(lo, hi, False, True))).when((at == lo) & (to == hi), F.array(span(lo, hi, True, True)))
    return ends.withColumn("v", F.explode(found.otherwise(F.array(span(at, to, True, False), span(lo, hi, False, True))))).where("v.hi > v.lo")


def _in_cells(spans: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """spans of side a by the power of two below their length (size) and where they begin in steps of it (cell), and spans of side b
    once for each size and cell of what they may share `least` of: boxes share no more of their area than of their stretches of the
    seam, so lengths are within that ratio, and two beginnings lie no farther apart than (1 - least) / least of the shorter length,
    or (1 - least) / (1 + least) of the sum. A pair meets once. The slack is for rounding."""
    n, lo, slack = F.col("v.hi") - F.col("v.lo"), F.col("v.lo"), 1e-9
    size = lambda c: F.floor(F.log2(c)).cast("int")
    unit = F.pow(F.lit(2.0), F.col("size"))
    a = spans.where("side = 'a'").withColumn("size", size(n * (1 + slack)))
    b = spans.where("side = 'b'").withColumn("size", F.explode(F.sequence(size(n * (least * (1 - slack))), size(n * ((1 + 3 * slack) / least)))))
    most = F.least(2 * unit, n * ((1 + 3 * slack) / least))
    far = F.least((1 - least) / least * F.least(n, most), (1 - least) / (1 + least) * (n + most)) * (1 + slack) + slack
    cells = F.sequence(F.floor((lo - far) / unit), F.floor((lo + far) / unit))
    return a.withColumn("cell", F.floor(lo / unit)), b.withColumn("cell", F.explode(cells))


def _matched(near: DataFrame, kind: str, s: Settings, by: tuple, crowded: bool = False) -> DataFrame:
    """match_edges() of one kind. What a rule needs of one side is a column before the join."""
    rows = near.where(F.col("kind") == kind)
    g, b, over = G.quad("g"), G.quad("b"), G.quad("o")
    if kind == "arrow":
        known, rule, reach = {**{f"g{i}": v for i, v in enumerate(g)}, "angle": G.angle(g)}, _same_angle, s.endpoint_tol
    else:
        known, rule, reach = _cut(over), _same_object if kind == "object" else _same_text, 0.0
        known["h"] = g[3]
    known["orientation"] = F.col("orientation")
    # Two items that match come within reach of each other along the seam, so they share the band in which the later begins.
    along = F.when(
        F.col("orientation") == "vertical", F.struct(b[1].alias("lo"), (b[1] + b[3]).alias("hi"))
    ).otherwise(F.struct(b[0].alias("lo"), (b[0] + b[2]).alias("hi")))
    known |= {"lo": along["lo"] - reach, "hi": along["hi"] + reach}
    keys = [*by, "pair_ord"]
    # Out of an explode of one element: the rule asks some things of one side alone, and the optimizer would write them out, with all
    # they are made of, in the filter that meets every item with every pair of its tile.
    ends = rows.select(*keys, "side", "uid", F.explode(F.array(F.struct(*[v.alias(k) for k, v in known.items()]))).alias("k"))
    a, b_ = ({n: F.col(f"_{side}_{n}") for n in known} for side in "ab")
    if crowded and kind == "object":
        left, right = (
            side.select(*keys, "size", "cell", F.col("uid").alias(uid), *[F.col(f"v.{n}").alias(f"_{p}_in_{n}") for n in ("cut", "whole", "lo", "hi")], *[F.col(f"k.{n}").alias(f"_{p}_{n}") for n in known])
            for side, uid, p in zip(_in_cells(_spans(ends), s.overlap_iou), ("src", "dst"), "ab")
        )
        (cut, whole), seen = _object_views(a, b_, s), lambda n: F.col(f"_a_in_{n}") & F.col(f"_b_in_{n}")
        lo, hi, far, to = (F.col(f"_{p}_in_{n}") for p in "ab" for n in ("lo", "hi"))
        # Cheap and first, as it leaves few to the rule: two stretches share enough of what they cover, and the boxes overlap. The rule
        # comes out of an explode of one element, so that the join's own condition stays small.
        near_ = (F.least(hi, to) - F.greatest(lo, far)) * (1 + s.overlap_iou) >= ((hi - lo) + (to - far)) * (s.overlap_iou * (1 - 1e-9))
        over = (F.least(a["x2"], b_["x2"]) > F.greatest(a["x"], b_["x"])) & (F.least(a["y2"], b_["y2"]) > F.greatest(a["y"], b_["y"]))
        rule = F.when(seen("cut") & cut, True).otherwise(seen("whole") & whole & (seen("cut") | ~cut))
        met = left.join(right, [*keys, "size", "cell"]).where(near_ & over).withColumn("_same", F.explode(F.array(rule))).where("_same")
        return met.select(*by, F.lit(kind).alias("kind"), "pair_ord", "src", "dst")
    band = lambda v: F.floor(v / F.lit(float(BAND)))
    ends = ends.withColumn("band", F.explode(F.sequence(band(F.col("k.lo")), band(F.col("k.hi")))))
    left, right = (
        ends.where(F.col("side") == side).select(*keys, "band", F.col("uid").alias(uid), *[F.col(f"k.{n}").alias(f"_{side}_{n}") for n in known])
        for side, uid in (("a", "src"), ("b", "dst"))
    )
    first = F.col("band") == band(F.greatest(a["lo"], b_["lo"]))
    met = left.join(right, [*keys, "band"]).where(first & rule(a, b_, s))
    if kind == "arrow":
        met = _same_line(met, a, b_, s)
    return met.select(*by, F.lit(kind).alias("kind"), "pair_ord", "src", "dst")


def match_edges(near: DataFrame, s: Settings, by: tuple = BY, kinds: tuple = KINDS, crowded: bool = False) -> DataFrame:
    """(by, kind, pair_ord, src, dst): candidates of the two sides of a pair that show the same thing.

    For each kind an equi-join on page, pair and band along the seam, with the rule as residual; its groups are what one
    stretch of a seam shows, so a crowded page is many keys. Rules suppose overlap_iou above 0. crowded: objects also meet by
    length only (_in_cells), several rows for each, which pays where a seam has thousands of them; the result is the same."""
    return reduce(DataFrame.unionByName, [_matched(near, k, s, by, crowded) for k in kinds])


def components(edges: DataFrame, by: tuple = BY, most: int = PAGE_EDGES) -> DataFrame:
    """(by, uid, root) of every uid with an edge: the least uid of its component within the page.

    Components never cross pages, so one shuffle by page brings each together, and all pages of a batch are labelled at once;
    a page of more than `most` edges is not brought to one task but goes through rounds over the cluster."""
    edges = kept(edges.select(*by, "src", "dst"))
    sizes = edges.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by)
    large = kept(sizes)
    types = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by)

    def labelled(t: pa.Table, page: np.ndarray) -> pa.Table:
        """Whole pages at once: a node is its page and its uid's place in the order of all uids here."""
        named = pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(named.dictionary).to_numpy()
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ends = np.concatenate([page, page]) * len(order) + rank[named.indices.to_numpy()].astype(np.int64)
        nodes, place = np.unique(ends, return_inverse=True)
        u, v = np.split(place, 2)
        label = np.arange(len(nodes))
        while True:  # each round takes over the least label around, then that label's label
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                break
            label = new
        uids = named.dictionary.take(pa.array(order))
        key = [t.column(c).take(pa.array(np.searchsorted(page, nodes // len(order)))) for c in by]
        return pa.table([*key, uids.take(pa.array(nodes % len(order))), uids.take(pa.array(nodes[label] % len(order)))], [*by, "uid", "root"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; the last page may go on in the next batch."""
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            codes = [held.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
            page = np.concatenate([[0], np.cumsum(np.any([np.diff(c) != 0 for c in codes], axis=0))])
            cut = held.num_rows if b is None else int(np.searchsorted(page, page[-1]))
            if cut:
                yield from labelled(held.slice(0, cut), page[:cut]).to_batches()
            held = held.slice(cut)

    small = edges if large.isEmpty() else edges.join(large, [*by], "left_anti")
    out = small.repartition(*by).sortWithinPartitions(*by).mapInArrow(pages, f"{types}, uid string, root string")
    return kept(out if small is edges else out.unionByName(_rounds(edges.join(large, [*by], "left_semi"), by)))


def _rounds(edges: DataFrame, by: tuple) -> DataFrame:
    """components() by minimum labels with pointer jumping: rounds grow with the logarithm of a chain's length."""
    spark = edges.sparkSession
    both = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"))
    both, at = kept_at(both.unionByName(both.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels, old = kept_at(both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        around = both.join(labels.select(*by, F.col("u").alias("v"), F.col("l").alias("n")), [*by, "v"]).groupBy(*by, "u").agg(F.min("n").alias("n"))
        step = labels.join(around, [*by, "u"]).select(*by, "u", F.least("l", "n").alias("l"), F.col("l").alias("was"))
        jump = step.select(*by, F.col("u").alias("l"), F.col("l").alias("far"))
        new, path = kept_at(step.join(jump, [*by, "l"]).select(*by, "u", F.least("l", "far").alias("l"), "was"))
        changed = not new.where("l <> was").isEmpty()
        remove(spark, old)
        labels, old = new.drop("was"), path
        if not changed:
            remove(spark, at)
            return labels.select(*by, F.col("u").alias("uid"), F.col("l").alias("root"))


def grouped(cands: DataFrame, roots: DataFrame, by: tuple = BY) -> DataFrame:
    """Candidates with root; those without an edge are their own."""
    return cands.join(roots, [*by, "uid"], "left").withColumn("root", F.coalesce("root", "uid"))


def vote(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label): most summed confidence (0.5 where null), then longest, then first seen. Sums are exact decimals."""
    each = members.groupBy(*keys, "label").agg(
        F.sum(F.coalesce(F.col("confidence"), F.lit(0.5)).cast("decimal(18,6)")).alias("score"), F.min("ord").alias("first")
    )
    return each.groupBy(*keys).agg(F.max_by("label", F.struct("score", F.length("label"), -F.col("first"))).alias("label"))


def _seen() -> list[Column]:
    return [
        F.min("ord").alias("group_ord"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("tile_id")).alias("source_tiles"),
        F.count("*").alias("members")
    ]


def _around() -> list[Column]:
    """The box around all members."""
    return [F.min("g0").alias("g0"), F.min("g1").alias("g1"), F.max(F.col("g0") + F.col("g2")).alias("_x2"), F.max(F.col("g1") + F.col("g3")).alias("_y2")]


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumns({"g2": F.col("_x2") - F.col("g0"), "g3": F.col("_y2") - F.col("g1")}).drop("_x2", "_y2")


def _score() -> Column:
    return F.sum(F.coalesce(F.col("confidence"), F.lit(0.5)).cast("decimal(18,6)")).alias("score")


def _seen_of_labels() -> list[Column]:
    """_seen() of a group from those of its labels, and the label voted."""
    tiles = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_tiles")))).alias("source_tiles")
    voted = F.max_by("label", F.struct("score", F.length("label"), -F.col("group_ord"))).alias("label")
    return [F.min("group_ord").alias("group_ord"), F.max("confidence").alias("confidence"), F.sum("members").alias("members"), tiles, voted]


def fuse_objects(members: DataFrame, by: tuple = BY) -> DataFrame:
    """One row per group: the box around it and the label voted. Labels of a group are summed first, then compared."""
    keys = [*by, "root"]
    each = members.groupBy(*keys, "label").agg(*_around(), *_seen(), _score())
    over = [F.min("g0").alias("g0"), F.min("g1").alias("g1"), F.max("_x2").alias("_x2"), F.max("_y2").alias("_y2")]
    return _sized(each.groupBy(*keys).agg(*over, *_seen_of_labels()))


def fuse_arrows(members: DataFrame, by: tuple = BY) -> DataFrame:
    """The first longest member gives the direction; the ends are the members' outermost endpoints along it."""
    keys = [*by, "root"]
    line = F.struct(*[f"g{i}" for i in range(4)])
    longest = Window.partitionBy(*keys).orderBy(F.desc(G.length(G.quad("g"))), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = members.withColumn("r", F.first(line).over(longest))  # one shuffle: what follows groups by the same keys
    dx, dy = F.col("r.g2") - F.col("r.g0"), F.col("r.g3") - F.col("r.g1")
    n = G.distance(dx, dy)
    n = F.when(n == 0, 1.0).otherwise(n)
    rows = rows.withColumns({"ux": dx / n, "uy": dy / n})

    def at(x: Column, y: Column) -> Column:
        along = (x - F.col("r.g0")) * F.col("ux") + (y - F.col("r.g1")) * F.col("uy")
        return F.struct(along.alias("p"), x.alias("x"), y.alias("y"))

    g = G.quad("g")
    rows = rows.withColumns({"_a": at(g[0], g[1]), "_b": at(g[2], g[3])})
    each = rows.groupBy(*keys, "label").agg(
        F.min(F.least("_a", "_b")).alias("lo"), F.max(F.greatest("_a", "_b")).alias("hi"), F.min_by(line, "ord").alias("one"), *_seen(), _score()
    )
    out = each.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("one", "group_ord").alias("one"), *_seen_of_labels())
    single = F.col("members") == 1
    ends = (F.col("lo.x"), F.col("lo.y"), F.col("hi.x"), F.col("hi.y"))
    out = out.withColumns({f"g{i}": F.when(single, F.col(f"one.g{i}")).otherwise(e) for i, e in enumerate(ends)}).drop("lo", "hi", "one")
    return out


def fuse_texts(members: DataFrame, by: tuple = BY) -> DataFrame:
    """Fragments folded in reading order; two readings of one region keep the fuller one. Members are those of one text."""
    item = F.struct("g0", "g1", "g2", "g3", "ord", "label")
    upright = F.min(F.col("g3") > 2 * F.col("g2")).alias("upright")
    out = _sized(members.groupBy(*by, "root").agg(*_around(), *_seen(), F.collect_list(item).alias("m"), upright))

    def order(first: str, second: str) -> Column:
        placed = F.transform("m", lambda x: F.struct(x[first].alias("p"), x[second].alias("q"), x["ord"].alias("o"), x.alias("x")))
        return F.transform(F.array_sort(placed), lambda y: y["x"])

    out = out.withColumn("m", F.when(F.col("upright"), order("g1", "g0")).otherwise(order("g0", "g1")))
    box = lambda x: tuple(x[f"g{i}"] for i in range(4))

    def fold(acc: Column, x: Column) -> Column:
        joined = join_fragments(acc["label"], x["label"])
        a, b = box(acc), box(x)
        twice = G.overlaps(a, b) & (G.area(G.intersection(a, b)) >= 0.6 * F.least(G.area(a), G.area(b)))
        fuller = F.when(F.length(x["label"]) > F.length(acc["label"]), x["label"]).otherwise(acc["label"])
        label = F.coalesce(joined, F.when(twice, fuller).otherwise(F.concat_ws(" ", acc["label"], x["label"])))
        x0, y0 = F.least(a[0], b[0]), F.least(a[1], b[1])
        w, h = F.greatest(a[0] + a[2], b[0] + b[2]) - x0, F.greatest(a[1] + a[3], b[1] + b[3]) - y0
        return F.struct(x0.alias("g0"), y0.alias("g1"), w.alias("g2"), h.alias("g3"), label.alias("label"))

    first = F.get("m", F.lit(0))
    start = F.struct(*[first[f"g{i}"].alias(f"g{i}") for i in range(4)], first["label"].alias("label"))
    rest = F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))
    return out.withColumn("label", F.aggregate(rest, start, fold)["label"]).drop("m", "upright")


FUSERS = {"object": fuse_objects, "arrow": fuse_arrows, "ocr": fuse_texts}


def merge(
    detections: DataFrame | None, s: Settings, by: tuple = BY, decisions: DataFrame | None = None, labels: DataFrame | None = None, layout: DataFrame | None = None,
    cands: DataFrame | None = None,
) -> DataFrame:
    """(by, kind, g0..g3, label, confidence, source_tiles, members, group_ord): the merged rows of every page.

    Edges are those of geometry, or of decisions (by, pair_ord, src, dst; src = dst relabels an item) with labels
    (by, uid, label): a group of several takes the label of its first member that has one.
    Order within a page and kind is (g1, g0, group_ord). Pages without detections give no rows; items that no rule
    joins come out as they are; a null confidence stays null where all of a group's are. With a layout, detections of
    tiles that their page does not have are left out. Callers that have candidates() written hand them in as cands instead."""
    cands = kept(candidates(detections, s, by, layout)) if cands is None else cands
    if decisions is None:
        edges = match_edges(seam_candidates(cands, s, by, layout), s, by)
    else:
        edges = decisions.where("src <> dst").select(*by, "src", "dst")
        alone = decisions.where("src = dst").groupBy(*by, F.col("src").alias("uid")).agg(F.max_by("label", "pair_ord").alias("relabel"))
        cands = cands.join(alone, [*by, "uid"], "left").withColumn("label", F.coalesce("relabel", "label")).drop("relabel")
    members = kept(grouped(cands, components(edges, by), by))
    columns = [*by, "kind", "g0", "g1", "g2", "g3", "label", "confidence", "source_tiles", "members", "group_ord"]
    parts = [f(members.where(F.col("kind") == k), by).withColumn("kind", F.lit(k)).select("root", *columns) for k, f in FUSERS.items()]
    out = reduce(DataFrame.unionByName, parts)
    if labels is not None:
        named = members.join(labels.withColumnRenamed("label", "given"), [*by, "uid"]).groupBy(*by, "root").agg(F.min_by("given", "ord").alias("given"))
        given = (F.col("members") > 1) & F.col("given").isNotNull()
        out = out.join(named, [*by, "root"], "left").withColumn("label", F.when(given, F.col("given")).otherwise(F.col("label")))
    return out.select(*columns)


def report(merged: DataFrame, near: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, pairs, merged_groups): seams compared and groups of more than one member on each page."""
    pairs = active_pairs(near, by).groupBy(*by).agg(F.count("*").alias("pairs"))
    groups = merged.groupBy(*by).agg(F.count_if(F.col("members") > 1).alias("merged_groups"))
    return groups.join(pairs, [*by], "left").select(*by, F.coalesce("pairs", F.lit(0)).alias("pairs"), "merged_groups")


def in_order(merged: DataFrame, by: tuple = BY) -> DataFrame:
    """Merged rows with place, their position within page and kind."""
    return merged.withColumn("place", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("g1", "g0", "group_ord")))
