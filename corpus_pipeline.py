"""A corpus pipeline: toxicity, quality rules, near-dedup, decontamination, packing.

``STAGES`` are applied in order, each to all that its predecessor kept; :func:`run` does
so on ``documents``. Every stage but the last returns the columns of ``documents``. The
toxicity model is fitted on the labels of the tables themselves (held-out rows left out),
never on what a stage sees, so a stage's decisions depend on its own input and the labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataview.llm import decontaminate, near_dup, packing, quality_rules, toxicity
from strataview.llm.queries import tokenizer
from strataview.llm.shared import held_out, scratch, small_batches, staged, table  # noqa: F401

MAX_TOXICITY = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    model = toxicity.fit(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.where(F.col("score") < MAX_TOXICITY).select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    leaked = decontaminate.is_contaminated(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.select(row, leaked.alias("leaked")).where(~F.col("leaked")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.bucketed(packing.pack(docs, tokenizer(), 2048, 1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("pack", pack),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as keep:  # what a stage wrote on its way goes when its rows are written
            docs = keep(stage(spark, docs, sf_dir))
    return docs
