"""Results of pages and jobs: merged items back in the original image, nested page documents, views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as G
from sheetweave.functions.numbers import exact_round
from sheetweave.operators import drift

CANVAS = ("orig_w", "orig_h", "rotated", "scale", "new_w", "new_h", "pad_x", "pad_y")
#: Names of the three lists of a document (fixed values).
LISTS = {"object": "OBJECT/COMPONENT", "ocr": "OCR", "arrow": "Annotation Arrow"}


def original_coords(merged: DataFrame, fit: DataFrame, by: tuple = ("page",), digits: int | None = None) -> DataFrame:
    """merged with g0..g3 in pixels of the original image instead of the canvas. fit: canvas_fit() of each page.

    Boxes stay boxes: the one around their moved corners. Lines keep their direction. digits rounds, as documents show them."""
    rows = merged.join(fit.select(*by, F.struct(*CANVAS).alias("_t")), [*by])
    return rows.withColumns({f"g{i}": v for i, v in enumerate(_moved(F.col("_t"), digits))}).drop("_t")


def _moved(t: Column, digits: int | None) -> list[Column]:
    """g0..g3 in the original image of a page that was fitted by t."""
    g = G.quad("g")
    line = (*G.to_original(g[0], g[1], t), *G.to_original(g[2], g[3], t))
    moved = [F.when(F.col("kind") == "arrow", a).otherwise(b) for a, b in zip(line, G.moved_box(g, t, G.to_original))]
    return [exact_round(v, digits) if digits is not None else v for v in moved]


def _lists(order: list, geometry: list) -> Column:
    """An aggregate: a struct of the three lists, items in the given order, confidences with four digits."""
    item = F.struct(F.array(*geometry).alias("geometry"), "label", exact_round(F.col("confidence"), 4).alias("confidence"), "source_tiles").alias("i")
    placed = F.struct(*order, item)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, placed))), lambda x: x["i"]).alias(n) for k, n in LISTS.items()]
    return F.struct(*lists)


def page_results(detections: DataFrame, merged: DataFrame, fit: DataFrame, report: DataFrame, by: tuple = ("page",)) -> DataFrame:
    """One nested document per page of fit: canvas, what each tile showed, what was merged (on the canvas and in the original
    image), the merge report and counts. Pages without detections have empty lists. A document holds one page's items."""
    g = [F.col(f"g{i}") for i in range(4)]
    items = _lists(["item_idx"], g).alias("items")
    tile_items = detections.withColumn("source_tiles", F.array("tile_id")).groupBy(*by, "tile_id").agg(items)
    tiles = tile_items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tile_id", "items"))).alias("tiles"))
    order = ["g1", "g0", "group_ord"]
    placed = merged.join(fit.select(*by, F.struct(*CANVAS).alias("_t")), [*by]).withColumn("_o", F.array(*_moved(F.col("_t"), 1)))
    back = [F.col("_o")[i] for i in range(4)]
    both = placed.groupBy(*by).agg(_lists(order, g).alias("merged"), _lists(order, back).alias("merged_original_coords"))
    seen = [c for c in report.columns if c not in by]
    facts = report.select(*by, F.struct(*seen).alias("merge_report"))
    out = fit.select(*by, F.struct(*CANVAS).alias("canvas"))
    for part in (tiles, both, facts):
        out = out.join(part, [*by], "left")
    none = {c: F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in out.schema[c].dataType]) for c in ("merged", "merged_original_coords")}
    none |= {"tiles": F.array().cast(out.schema["tiles"].dataType), "merge_report": F.struct(*[F.lit(0).cast(report.schema[c].dataType).alias(c) for c in seen])}
    out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    return out.withColumn("counts", F.struct(*[F.size(F.col(f"merged.`{n}`")).alias(n) for n in LISTS.values()]))


def merged_view(results: DataFrame, by: tuple = ("page",)) -> DataFrame:
    """The short form of page documents: without tiles and original coordinates."""
    return results.select(*by, *[c for c in ("image_id", "merged", "counts", "drift") if c in results.columns])


def job_view(jobs: DataFrame) -> DataFrame:
    """What a caller sees of a job: everything but where its file lies, the time it took in seconds added."""
    seen = [c for c in jobs.columns if c != "input_file_id"]
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return jobs.select(*seen, exact_round(took / 1e6, 3).alias("seconds"))


def job_drift(pages: DataFrame) -> DataFrame:
    """(job_id, pages, drift): a job has drifted if any of its pages has."""
    return drift.any_drift(pages).join(pages.groupBy("job_id").agg(F.count("*").alias("pages")), "job_id")


def readiness(checks: DataFrame) -> DataFrame:
    """(service, ready, failing): ready if all checks (service, name, ok) pass; an unknown outcome has not passed."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    failing = F.array_sort(F.collect_list(F.when(~ok, F.col("name"))))
    return checks.groupBy("service").agg(F.bool_and(ok).alias("ready"), failing.alias("failing"))


def image_id(base: Column, page: Column, pages: Column) -> Column:
    """A file of one page lends it its name; of several pages each adds _P and its number from 1."""
    return F.when(pages == 1, base).otherwise(F.concat(base, F.lit("_P"), (page + 1).cast("string")))
