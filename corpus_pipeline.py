"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing and tokenisation, each over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last keep the columns of documents, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm import bpe, jaccard, mixing, pii, simhash, toxicity
from sheetweave.llm.shared import shelve

#: Stages train a model, compare all pairs, encrypt and encode, which SQL can't express; tests/llm holds each against a plain form.
ORACLE_SQL = None


#: Rows that Spark passes to Python at a time: few where they hold whole texts, Spark's own number elsewhere.
TEXTS, ROWS = 1_000, 10_000


def _at_a_time(spark: SparkSession, rows: int) -> None:
    """A stage returns before it runs, so the setting stays until the next stage sets its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is fitted on the labelled documents of sf_dir outside the held-out fold.

    Null and empty texts score below 0.5 and stay, repeated rows share their fate, texts of any length are read whole;
    columns stay whatever their names; an empty table stays empty."""
    _at_a_time(spark, TEXTS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, c = toxicity.score(docs, model)
    return scored.where(F.col(c) < 0.5).drop(c)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 stays: the one of least
    id, of repeated rows one. A document whose id is null stays only if its component has no id. Texts without words
    (null, empty) form one component, so one of them stays. Texts of any length are compared whole; columns stay whatever
    their names; an empty table stays empty."""
    _at_a_time(spark, ROWS)
    return simhash.keep_one(docs, group=jaccard.dedup)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes pseudonyms; every document stays, and where a text changed n_chars follows.

    Null and empty texts stay as they are, repeated rows get equal pseudonyms, texts of any length are read whole; other
    columns stay whatever their names (n_chars may be missing); an empty table stays empty."""
    _at_a_time(spark, TEXTS)
    masked, c = pii.mask(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(c) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.drop(c)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as the mix takes them, 0 to 2 times.

    A null source is a source, a null id an id; repeated rows each count; texts without words (null, empty) take no
    budget; texts of any length count whole; columns stay whatever their names; an empty table stays empty."""
    _at_a_time(spark, ROWS)
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, intact): token ids of each document, and whether they decode to its text.

    A null text is encoded as an empty one and has no tokens; rows, also repeated ones and those with a null id, come out
    one for one; texts of any length are encoded whole; other columns go; an empty table stays empty."""
    _at_a_time(spark, TEXTS)
    coded, c = bpe.transcode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    s = coded[c]
    intact = s["decoded"] == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size(s["ids"]).cast("long").alias("n_tokens"), s["ids"].alias("ids"), intact.alias("intact"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shelve(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
