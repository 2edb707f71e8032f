"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.shared import remove, shelve_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller-or-equal neighbours are tied to the least of its neighbours and itself."""
    if large:
        around = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        around = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = around.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("of"), F.least("m", "src").alias("m"))
    tied = around.join(least, F.col("src") == F.col("of"))
    if large:
        out = tied.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = tied.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("of").alias("src"), F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (src, dst: long); root is the least node of the component.

    Nodes without an edge do not appear, nulls and self-loops are ignored. Each round is written to the shared folder;
    rounds grow with the logarithm of the longest path. A node of very high degree is a key of partial minima and of a
    join that Spark can split, never a list in memory.
    """
    spark = edges.sparkSession
    edges, old = shelve_at(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct())
    seen = None
    while True:
        new, path = shelve_at(_star(_star(edges, large=True), large=False))
        state = new.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        remove(spark, old)
        edges, old = new, path
        if state == seen or not state[0]:
            break
        seen = state
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
