"""Quality rules with thresholds learnt from mergeable quantile sketches per language and source.

The sketch of a metric is a histogram over relative-error buckets: a whole number keeps its five leading binary
digits, so a bucket is at most 1/16 of its value wide. Such sketches merge by adding counts (a groupBy with map-side
partial sums), merge again upwards from (language, source) to language to everything, and give the same quantiles
whatever the partitioning. A group's quantiles are drawn towards its language's, and a language's towards the corpus's,
as if PRIOR documents of the wider group had been seen besides its own: a small group leans on the wider one, a large
one stands for itself, and no size changes the rule. Everything is DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.llm.shared import SPACE, column, let, shelve, words

WINDOW = 8
MIN_WORDS = 20
#: Documents of the wider group that a group's own quantiles are weighed against.
PRIOR = 200
#: metric: (lower fence wanted, times the spread, least spread). Fences: quartile -/+ times * max(spread, least).
#: Where a group's norm is 0, the fence for repeats is 225 per mille: below the base rule's 300, above a line repeated once in 80 words.
FENCES = {"symbols": (False, 3, 15), "dup_lines": (False, 4, 100), "repeats": (False, 3, 75), "word_length": (True, 4, 30)}


def _repeated(w: Column) -> Column:
    """Words of array w that lie in WINDOW-word windows found twice or more.

    Windows are compared by a 64-bit hash of their words. Documents whose windows all differ stop at the distinct
    count; for others the windows are sorted by hash, so no step is quadratic in the text.
    """
    hashes = F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))

    def covered(h: Column) -> Column:
        sorted_ = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(sorted_, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda e: e["p"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.coalesce(
        let(hashes, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), covered(h)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long")
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) for each row."""
    text = F.coalesce(column(docs, text_col), F.lit(""))
    raw = docs.select(column(docs, id_col).alias("doc_id"), column(docs, lang_col).alias("lang"), column(docs, source_col).alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = raw.withColumn("w", words(F.col("text"))).select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _repeated(F.col("w")).alias("n_repeat_words"),
    )
    out = out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"),
        "n_repeat_words"
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _metrics() -> dict[str, Column]:
    """Whole numbers: thousandths, and hundredths of a character for the mean word length. Only for rows with words."""
    return {
        "symbols": F.expr("n_symbols * 1000 div word_chars"),
        "dup_lines": F.expr("n_dup_lines * 1000 div n_lines"),
        "repeats": F.expr("n_repeat_words * 1000 div n_words"),
        "word_length": F.expr("word_chars * 100 div n_words"),
    }


def fences(measured: DataFrame) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high ...), one row per language and source among rows that pass the base rules."""
    stacked = measured.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("x")) for m, v in _metrics().items()])).alias("e")
    ).select("lang", "source", "e.metric", "e.x")
    digits = F.expr("shiftleft(shiftright(x, greatest(length(bin(x)) - 5, 0)), greatest(length(bin(x)) - 5, 0))")
    sketch = stacked.select("lang", "source", "metric", digits.alias("x")).groupBy("lang", "source", "metric", "x").agg(F.count("*").alias("n"))
    by_lang = sketch.groupBy("lang", "metric", "x").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "x").agg(F.sum("n").alias("n"))
    groups = measured.select("lang", "source").distinct()
    best = reduce(
        lambda left, level: left.join(
            level[0], reduce(lambda a, b: a & b, [left[c].eqNullSafe(level[0][f"{c}_{level[1]}"]) for c in level[2]], F.lit(True)), "left"
        ),
        [(_quartiles(sketch, ["lang", "source"], "s"), "s", ["lang", "source"]), (_quartiles(by_lang, ["lang"], "l"), "l", ["lang"])],
        groups,
    ).crossJoin(F.broadcast(_quartiles(overall, [], "o")))  # one row
    out = [F.col("lang"), F.col("source")]
    for m, (lower, times, least) in FENCES.items():
        q25, q75 = (_drawn(_drawn(F.col(f"{m}_o.{q}").cast("double"), F.col(f"{m}_l"), q), F.col(f"{m}_s"), q) for q in ("q25", "q75"))
        reach = times * F.greatest(q75 - q25, F.lit(float(least)))
        out += [(q75 + reach).alias(f"{m}_high")] + ([(q25 - reach).alias(f"{m}_low")] if lower else [])
    return best.select(*out)


def _drawn(wider: Column, own: Column, q: str) -> Column:
    """A quantile of a group's own, weighed against the wider group's by its number of documents; without any, the wider one."""
    n = own["n"].cast("double")
    return F.coalesce((n * own[q] + PRIOR * wider) / (n + PRIOR), wider)


def _quartiles(sketch: DataFrame, by: list[str], tag: str) -> DataFrame:
    """One row per group with a struct <metric>_<tag> (n, q25, q75) for each metric. Windows see buckets, not documents."""
    w = Window.partitionBy(*by, "metric")
    cum = sketch.withColumn("upto", F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    pick = lambda m, share: F.min(F.when((F.col("metric") == m) & (F.col("upto") * 4 >= F.col("total") * share), F.col("x")))
    aggs = [F.struct(
        F.max(F.when(F.col("metric") == m, F.col("total"))).alias("n"), pick(m, 1).alias("q25"), pick(m, 3).alias("q75")
    ).alias(f"{m}_{tag}") for m in FENCES]
    return cum.groupBy(*by).agg(*aggs).select(*[F.col(c).alias(f"{c}_{tag}") for c in by], *[f"{m}_{tag}" for m in FENCES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measures() of each row and kept: it passes the base rules and lies within its group's fences.

    A null text has no words and fails the base rules, as an empty one does. Null languages and sources are groups of
    their own. Texts of any length are measured whole. Repeated rows count each; other columns are ignored, whatever their
    names. An empty table gives an empty result; where no row passes the base rules no fence exists and nothing is kept.
    """
    measured = shelve(measures(docs, id_col, text_col, lang_col, source_col))
    limits = fences(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    within = reduce(lambda a, b: a & b, [(v <= F.col(f"{m}_high")) & ((v >= F.col(f"{m}_low")) if FENCES[m][0] else F.lit(True)) for m, v in _metrics().items()])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(False)))
    return joined.select(*measured.columns, kept.alias("kept"))


def _sql_quartiles(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {keys}metric, max(total) AS n, min(CASE WHEN upto * 4 >= total THEN x END) AS q25, min(CASE WHEN upto * 4 >= total * 3 THEN x END) AS q75
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS total
        FROM (SELECT {keys}metric, x, sum(n) AS n FROM sketch GROUP BY {keys}metric, x))
  GROUP BY {keys}metric)"""


#: The same rows as `judge` with its defaults.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
wins AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS p, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda p: array_to_string(w[p:p+{WINDOW - 1}], ' '))) AS s FROM w WHERE len(w) > {WINDOW}),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS k FROM wins) WHERE k > 1),
cover AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m0 AS (SELECT d.doc_id, d.lang, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l.l) AS BIGINT) AS n_lines, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
       FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN cover USING (r)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
x AS (SELECT row_number() OVER () AS r, *, n_symbols * 1000 // nullif(word_chars, 0) AS symbols, n_dup_lines * 1000 // nullif(n_lines, 0) AS dup_lines,
         n_repeat_words * 1000 // nullif(n_words, 0) AS repeats, word_chars * 100 // nullif(n_words, 0) AS word_length FROM m),
stacked AS (SELECT r, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric, unnest([symbols, dup_lines, repeats, word_length]) AS x FROM x),
sketch AS (SELECT lang, source, metric, (x >> greatest(length(bin(x)) - 5, 0)) << greatest(length(bin(x)) - 5, 0) AS x, count(*) AS n FROM stacked WHERE NOT base_failed GROUP BY ALL),
{_sql_quartiles("qs", "lang, source")}, {_sql_quartiles("ql", "lang")}, {_sql_quartiles("qo", "")},
f(metric, lower, times, least) AS (VALUES {", ".join(f"('{m}', {str(a).lower()}, {b}, {c})" for m, (a, b, c) in FENCES.items())}),
p AS (SELECT s.r, s.metric, s.x, {", ".join(f"coalesce((CAST(qs.n AS DOUBLE) * qs.{q} + {PRIOR}.0::DOUBLE * l.{q}) / (CAST(qs.n AS DOUBLE) + {PRIOR}.0::DOUBLE), l.{q}) AS {q}" for q in ("q25", "q75"))}
      FROM stacked s
        JOIN (SELECT g.lang, g.metric, {", ".join(f"coalesce((CAST(ql.n AS DOUBLE) * ql.{q} + {PRIOR}.0::DOUBLE * CAST(qo.{q} AS DOUBLE)) / (CAST(ql.n AS DOUBLE) + {PRIOR}.0::DOUBLE), CAST(qo.{q} AS DOUBLE)) AS {q}" for q in ("q25", "q75"))}
              FROM (SELECT DISTINCT lang, metric FROM stacked) g LEFT JOIN ql ON g.lang IS NOT DISTINCT FROM ql.lang AND g.metric = ql.metric LEFT JOIN qo ON g.metric = qo.metric) l
          ON s.lang IS NOT DISTINCT FROM l.lang AND s.metric = l.metric
        LEFT JOIN qs ON s.lang IS NOT DISTINCT FROM qs.lang AND s.source IS NOT DISTINCT FROM qs.source AND s.metric = qs.metric
      WHERE NOT s.base_failed),
v AS (SELECT p.r, bool_and(p.x <= q75 + f.times * greatest(q75 - q25, CAST(f.least AS DOUBLE)) AND (NOT f.lower OR p.x >= q25 - f.times * greatest(q75 - q25, CAST(f.least AS DOUBLE)))) AS within
      FROM p JOIN f ON f.metric = p.metric GROUP BY p.r)
SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, NOT x.base_failed AND coalesce(v.within, false) AS kept
FROM x LEFT JOIN v USING (r)
"""
