"""The corpus pipeline: five stages over ``documents``, each one operator of ``sparkloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with their columns; the last
returns packed pieces.  Between stages the documents are written as Parquet and read again.

Of all stages: an empty table stays empty, rows that repeat get equal answers, and further columns stay as they
are, also under a name that an operator works with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join, language_id, packing, quality_rules, queries, secret_scan
from sparkloom.llm.columns import set_aside
from sparkloom.llm.workspace import Workspace


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts each document's language; it replaces ``lang``.  Documents without a letter, and those
    whose language no machine is sure of, go, null and empty texts among them; with no labelled row at all, every one.
    Rows with a null ``doc_id`` are not learnt from; null labels neither."""
    model = language_id.fit(docs.where(~queries.held_out()))
    own, back = set_aside(docs, ["lang_pred", "score"])
    told = language_id.identify(own, model)
    sure = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.MIN_SCORE))
    return back(sure.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their divergence from all language references rejects go.  A null text
    measures as empty and goes, as do all under 50 words; a null ``lang`` only makes a row no part of the references."""
    return quality_rules.passing(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8.  Documents without
    words, and those with a null ``doc_id``, stay; rows that repeat an id and its text become one."""
    return jaccard_join.one_of_each(docs, threshold=80, shingle=5)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; ``n_chars`` follows.  All documents stay; a null text stays null."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids.  A null text is packed as its end token; null ids stay null,
    repeated rows are packed each."""
    return packing.pack(docs, queries.tokenizer(spark))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the machines nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.write(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
