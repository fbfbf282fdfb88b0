"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm import (
    decontamination, fill_in_middle, language_model, mixing, sentence_spans, sharding, simhash, suffix_dedup, topk,
    toxicity, url_filter, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark, sf_dir):
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", digest, mixing.words().alias("n_words"))
    return mixing.mix(docs, tokens="n_words", content="digest").select(
        "doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")


def op2_extendible_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast(
        "bigint").alias("n_bytes"))
    return sharding.shard(docs).select(
        "doc_id", "n_bytes", "shard", F.col("shard_depth").cast("bigint"), "shard_bytes", "shard_rows")


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_cover_tree_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows)


def op7_decontamination(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", (F.size("contaminated_by") > 0).alias("contaminated"), "contaminated_by")


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op9_warc(spark, sf_dir):
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op10_sentence_spans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.without_repeats(docs).select(
        "doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored("fim_text", "fim_form"), 256).alias("restored_sha256"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_language_model(spark, sf_dir):
    return language_model.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_extendible_sharding, op3_toxicity, op4_url_filter, op5_suffix_dedup,
    op6_cover_tree_topk, op7_decontamination, op8_simhash, op9_warc, op10_sentence_spans,
    op11_fill_in_middle, op12_whitening,
    op13_language_model)}
