"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words its source has queued up to and with it, divided by
the source's target. Each document can be queued twice (a second epoch follows the first). Documents are taken in
the order of finish time until the total budget is spent.

No window spans a whole source: a source's shuffled order is cut into hash buckets whose number grows with the
table, the buckets' sums are accumulated first, and rows are accumulated within their bucket only. Sums of buckets are
accumulated in two levels, so no task sees all of them either. The budget's cut is found likewise: sums by slices of
virtual time, then rows of the one slice in which the budget runs out. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, n_words, scope, shelve, shelve_at

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
#: Rows that one bucket of a source's shuffled order, or one slice of virtual time, is meant to hold.
BUCKET_ROWS = 2_000
#: Buckets or slices whose sums are accumulated in one group.
LEVEL = 4_096


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of share * all sizes, none above epochs * its size.

    Filling up to the caps has a closed form: with sources by cap / weight, level k is what would be left for each
    unit of weight if all sources before k were at their caps; the level that holds is the largest of them.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, so these windows see source names, never documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("rank", rank).withColumn("weight", pick).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    by = by.withColumn("level", level)
    by = by.withColumn("level", F.max("level").over(everything))
    return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _spread(key: Column) -> Column:
    """A hash in hex as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def running(sums: DataFrame, by: list[str], order: str) -> DataFrame:
    """sums (by, order: whole number from 0, sum) with upto, the sum of this and all lower numbers, and paid, upto without
    its own. First the sums of LEVEL numbers each are accumulated (few rows), then the numbers within each."""
    level = sums.withColumn("level", F.floor(F.col(order) / F.lit(LEVEL)))
    totals = level.groupBy(*by, "level").agg(F.sum("sum").alias("total"))
    lower = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("lower", F.coalesce(F.sum("total").over(lower), F.lit(0))).drop("total")
    totals = totals.withColumnsRenamed({c: f"of_{c}" for c in (*by, "level")})
    same = F.col("level") == F.col("of_level")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    within = Window.partitionBy(*by, "level").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = level.withColumn("within", F.sum("sum").over(within)).join(totals, same).withColumn("upto", F.col("lower") + F.col("within"))
    return out.select(*by, order, "sum", "upto", (F.col("upto") - F.col("sum")).alias("paid"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, weights: tuple = WEIGHTS,
    epochs: int = EPOCHS, seed: str = SEED, keep: str | None = None
) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, copies, taken).

    size: words of the text (null text: 0). copies: times the mix takes the document, 0 to epochs; taken = copies * size.
    The order of a source is that of md5(seed, id), so reruns and other partitionings agree. A null source is a source
    of its own, the last; a null id is an id like any other; repeated rows each count; documents without words take no
    budget; texts of any length count whole; rows that finish at the same virtual time are taken together or not at all,
    so the mix may end below its budget by them; an empty table gives an empty result. Other columns of docs are ignored, whatever their names, but for the one named
    `keep`, which comes out as the column keep.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, id_col).cast("string"), F.lit("null"))))
    sizes = shelve(docs.select(
        column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"), n_words(column(docs, text_col)).alias("size"),
        key.alias("key"), *([column(docs, keep).alias("keep")] if keep else [])
    ))
    kept = ["keep"] if keep else []
    rows = sizes.count()
    buckets = max(1, rows // BUCKET_ROWS)
    share_of = targets(sizes, share, weights, epochs)
    placed = sizes.withColumn("bucket", F.floor(_spread(F.col("key")) * buckets).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sums = running(sums, ["source"], "bucket").withColumnRenamed("paid", "ahead")
    base = sums.join(
        share_of.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left"
    ).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    queued = placed.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.withColumn("queued", F.col("ahead") + F.sum("size").over(within))
    finish = [F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("queued")) / F.col("target")).alias(f"finish{e}") for e in range(epochs)]
    queued = shelve(queued.select("doc_id", "source", "size", "source_size", "target", *kept, *finish))
    end = _cut(queued, rows, epochs, share)
    copies = sum(
        (F.coalesce(F.col(f"finish{e}") <= F.col("end"), F.lit(False)).cast("long") for e in range(1, epochs)),
        F.coalesce(F.col("finish0") <= F.col("end"), F.lit(False)).cast("long")
    )
    out = queued.crossJoin(F.broadcast(end)).withColumn("copies", copies)  # the cut is one row
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


def _cut(queued: DataFrame, rows: int, epochs: int, share: float) -> DataFrame:
    """One row (end): the last finish time that the budget, share * all sizes, still pays for."""
    slices = max(1024, rows // BUCKET_ROWS)
    each = queued.select("size", F.explode(F.array(*[F.col(f"finish{e}") for e in range(epochs)])).alias("finish")).where("finish IS NOT NULL")
    each = each.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(4.0)) * slices).cast("long"))
    per = each.groupBy("slice").agg(F.sum("size").alias("sum"))
    budget = queued.agg((F.lit(share) * F.sum("size")).alias("budget"))
    per = running(per, [], "slice").crossJoin(F.broadcast(budget))  # one row
    over = F.min_by(F.struct("slice", "paid", "budget"), "slice").alias("x")
    last = per.where(F.col("upto") > F.col("budget")).agg(over).select("x.slice", "x.paid", "x.budget")
    edge = each.withColumnRenamed("slice", "of").join(F.broadcast(last), F.col("of") == F.col("slice"))  # one row
    edge = edge.withColumn(
        "paid", F.col("paid") + F.sum("size").over(Window.partitionBy("of").orderBy("finish", "size").rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = edge.where(F.col("paid") <= F.col("budget")).agg(F.max("finish").alias("inside"))
    # Without a slice that overdraws the budget everything is taken; without a row inside it, all slices before it.
    return last.agg(F.max("slice").alias("slice")).crossJoin(F.broadcast(inside)).select(
        F.when(F.col("slice").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.col("inside"), F.expr(f"(slice - 1e-9) / {slices}"))).alias("end")
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as mix() takes it, 0 to epochs times; all columns stay.

    Texts are not shuffled by source: a number for each row carries the decision back to them, and where the decisions are
    few enough for Spark to send them to the texts, those do not move at all.
    """
    row, copies, of, number = (free_name(docs, x) for x in ("row", "copies", "of", "times"))
    with scope(docs.sparkSession) as stays:
        held, at = shelve_at(docs.withColumn(row, F.monotonically_increasing_id()))
        taken = mix(held, id_col, text_col, source_col, keep=row, **how)
        found, of_found = shelve_at(taken.where("copies > 0").select(F.col("keep").alias(of), F.col("copies").cast("int").alias(number)))
        stays += [at, of_found]
    out = held.join(found, F.col(row) == F.col(of))
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(number)))).select(*[column(out, c) for c in docs.columns])


#: The same rows as `mix` with its defaults, over a whole source at a time.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
       FROM s2 WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM s3),
q AS (SELECT d.doc_id, d.size, s.source_size, s.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS queued
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
v AS (SELECT *, CASE WHEN target > 0 THEN queued / target END AS f0, CASE WHEN target > 0 THEN (source_size + queued) / target END AS f1 FROM q),
e AS (SELECT f0 AS f, size FROM v WHERE f0 IS NOT NULL UNION ALL SELECT f1, size FROM v WHERE f1 IS NOT NULL),
c AS (SELECT f, sum(size) OVER (ORDER BY f, size ROWS UNBOUNDED PRECEDING) AS paid FROM e),
x AS (SELECT max(f) AS cut FROM c WHERE paid <= (SELECT {SHARE}::DOUBLE * sum(size) FROM d))
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN f0 <= cut THEN 1 ELSE 0 END + CASE WHEN f1 <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM v CROSS JOIN x
"""
