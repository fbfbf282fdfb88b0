"""A training corpus in five stages, each one operator of ``tracemill.llm``.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, the sources are mixed to target weights, and the mix is dealt to shards of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm import decontamination, mixing, sharding, simhash, toxicity
from tracemill.llm.scratch import Scratch

REJECTED_FROM = 0.5


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. The model learns from the given labels alone."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    column = _fresh(docs, "toxicity")
    return toxicity.score(docs, model, column).where(F.col(column) < REJECTED_FROM).drop(column)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest doc_id.

    Texts are linked by fingerprints (pigeonring, as `op8_simhash` does) and, beyond its distance, as near copies.
    Groups are of rows, not of ids: rows that share an id but not their text stay, and rows without an
    id are in groups like others. Rows without words all stay; equal ones with an id stay once.
    """
    kept, repeated = simhash.one_per_group(docs)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", *simhash.text_key())
    if repeated.head(1):
        again = simhash.same_rows(base, repeated, "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
        base = simhash.same_rows(base, repeated, "left_anti").union(again)
    return simhash.same_rows(base, kept, "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    column = _fresh(docs, "contaminated_by")
    return decontamination.mark(docs, benchmark, column=column).where(F.size(column) == 0).drop(column)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their target weights."""
    return mixing.mix(docs).select(docs.columns)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they are in."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

# Scores of a learned model and fingerprints have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
