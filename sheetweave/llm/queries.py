"""The registered queries of this package: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm import ann, bpe, dialogue, fim, licenses, lm, mixing, pii, quality, simhash, substrings, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored, c = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), scored[c].alias("score"), (scored[c] >= 0.5).cast("int").alias("predicted")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = pii.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.sort_array(F.array_distinct(docs[c]["kind"])), ",")
    return docs.select("doc_id", "text", F.size(c).cast("long").alias("n_found"), kinds.alias("kinds"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = tokens.count(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", f"{c}.n_bytes", f"{c}.n_tokens", f"{c}.over_limit")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = bpe.transcode(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return docs.select("doc_id", *bpe.digest(docs[c]))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *licenses.digest(docs[c]))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs, back = fim.restore(docs.select("doc_id", c), c)
    s = docs[c]
    output, restored = F.sha2(s["output"], 256).alias("output_sha256"), F.sha2(docs[back], 256).alias("restored_sha256")
    return docs.select("doc_id", s["n"].alias("n"), s["form"].alias("form"), s["prefix_chars"].alias("prefix_chars"), s["middle_chars"].alias("middle_chars"), output, restored)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = substrings.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = docs[c]
    return docs.select("doc_id", s["n_words"].alias("n_words"), s["n_removed"].alias("n_removed"), F.sha2(s["kept"], 256).alias("kept_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.digest(*dialogue.rows_of(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict:
    found = (op1_toxicity, op2_simhash, op3_pii, op4_tokens, op5_quality, op6_lm, op7_bpe, op8_licenses, op9_neighbours, op10_mixing, op11_fim,
             op12_substrings, op13_conversations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.SQL, "op10_mixing": mixing.SQL, "op11_fim": fim.SQL, "op12_substrings": substrings.SQL, "op13_conversations": dialogue.SQL}
