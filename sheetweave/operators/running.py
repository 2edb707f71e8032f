"""Running values over an order of any length: of a key with a history of a billion rows no task sees more than its part.

Rows are range-partitioned by key and order and written with the number of their part, so every later step finds the same
parts. Values run within a part; what each part ends with (a row for each part and key) runs over the parts and is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.scratch import kept

#: Kinds of running values: sums, greatest values, and the last that is not null.
SUM, MAX, LAST = "sum", "max", "last"


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], before: bool = False, parts: int | None = None) -> DataFrame:
    """df with each named value (kind, column) up to its row, or `before` it, among rows of equal keys in an order.

    Nulls in keys are a key, nulls in a column count for nothing, and a value of nothing is null. Rows that the order
    leaves equal count in some order, so it should be total. parts: how many; else as many as Spark shuffles into."""
    taken = {c.lower() for c in df.columns}
    name = lambda n: n if n.lower() not in taken else name(n + "_")
    part, place = name("part_"), name("place_")
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(parts, *sort) if parts else df.repartitionByRange(*sort)
    own = {n: name(f"{n}_own_") for n in values}
    rows = kept(ranged.withColumns({part: F.spark_partition_id(), **{own[n]: c for n, (_, c) in values.items()}}))
    within = Window.partitionBy(part, *keys).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = {SUM: lambda c: F.sum(c), MAX: lambda c: F.max(c), LAST: lambda c: F.last(c, ignorenulls=True)}
    local = rows.withColumns({n: over[kind](F.col(own[n])).over(so_far) for n, (kind, _) in values.items()})
    # What a part ends with: of the last values that of the highest place that has one.
    numbered = rows.withColumn(place, F.row_number().over(within)) if any(kind == LAST for kind, _ in values.values()) else rows
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(place)))
    ends = numbered.groupBy(part, *keys).agg(*[(last(own[n]) if kind == LAST else over[kind](F.col(own[n]))).alias(n) for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = kept(ends.select(part, *keys, *[over[kind](F.col(n)).over(earlier).alias(n) for n, (kind, _) in values.items()]))
    carried = carried.where(" OR ".join(f"`{n}` IS NOT NULL" for n in values))
    met = local.join(carried, _same(local, carried, [part, *keys]), "left")

    def both(n: str, kind: str) -> Column:
        a, b = local[n], carried[n]
        if kind == SUM:
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        return F.greatest(a, b) if kind == MAX else F.coalesce(a, b)

    return met.select(*[local[c] for c in df.columns], *[both(n, kind).alias(n) for n, (kind, _) in values.items()])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, taken: list[str], ties: list[Column] | None = None, parts: int | None = None) -> DataFrame:
    """left with columns `taken` of the right row of equal keys that was the last at that time: of those not later than the
    row's `at` the latest, of several at one time the first by `ties`. Null where there was none; a null `at` meets none.

    One union and one running value, no join of a row with a history."""
    asks = left.select(F.struct(*left.columns).alias("l"), *keys, at, F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rank"))
    fields = F.struct(*taken).alias("v")
    ordered = Window.partitionBy(*keys, at).orderBy(*(ties or [F.lit(1)]))
    # Of one time and key only the first counts, so that none of its rivals is carried on.
    holds = right.where(F.col(at).isNotNull()).withColumn("_n", F.row_number().over(ordered)).where("_n = 1")
    holds = holds.select(*keys, at, F.lit(0).alias("kind"), fields)
    both = asks.drop("rank").unionByName(holds, allowMissingColumns=True)
    ran = running(both, keys, [F.col(at).asc_nulls_first(), F.col("kind").asc()], {"held": (LAST, F.col("v"))}, parts=parts)
    return ran.where("kind = 1").select("l.*", *[F.col(f"held.{c}").alias(c) for c in taken])
