"""A training corpus from ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, mixing, ngram_join, quality_rules, token_orc
from graphloom.llm.queries import tokenizer_path
from graphloom.plans.tables import write_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one id stay or go by each row's own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``, without its passages of 13 words or more."""
    clean = decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources uses them, at least once each."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # under names that meet none of the operator's
    mixed = mixing.mix_sources(docs.toDF(*own.values()), own["doc_id"], own["source"], own["text"])
    return mixed.select(*(F.col(n).alias(c) for c, n in own.items()))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token files: one row for each use of a document."""
    return token_orc.tokenize_to_orc(docs, tokenizer_path())


STAGES = [
    ("quality_rules", rules),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", tokens),
]
#: Binomial tests, signatures and a tokenizer are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
