"""A training corpus in five stages; each takes and (but for the last) returns documents.

Every stage works on all that the one before kept; its result is written as Parquet in
the shared folder and read again.  ORACLE_SQL is None: SQL can't express the stages;
tests hold them against brute force.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import decontam, jaccard, mixing, tokens, toxicity
from cityloom.llm.store import Workspace, table

#: Shares of expected tokens.  Every document stays at least once.
MIX = {"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.10, "low": 0.10}


def _any_columns(stage):
    """The stage with columns that it doesn't use renamed meanwhile, so no names clash."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"extra_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


@_any_columns
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.tagged(docs, model).where("_score < 0.5").select(*docs.columns)


@_any_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of linked documents.

    Two link from a Jaccard similarity of 0.8 of their sets of five words on.
    """
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


@_any_columns
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item or edited copy of one."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_any_columns
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by fitted rates of at least one."""
    out, _, _ = mixing.rated(docs, table(spark, sf_dir, "labels"), weights=MIX, total=-1.0, least=1.0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), mixing.copies())))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a slot of the shards in training order."""
    return tokens.materialised(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix_to_weights),
    ("token output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
