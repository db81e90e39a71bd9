"""The pipeline's stages on a small corpus with planted cases, and on hard rows."""

import pytest

import corpus_pipeline as P
from strataview.llm import near_dup, quality_rules

from .helpers import SF, hard_docs

#: Large enough for the toxicity model to be fitted: it needs five toxic labels in each half.
FITTED = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FITTED}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FITTED}/labels.parquet").collect()}
    quality = {r.doc_id for r in quality_rules.quality_rules(docs).where("not kept").collect()}
    now = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = P.staged(stage(spark, now, FITTED))
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert now.columns == docs.columns and after <= before
        gone = before - after
        if name == "toxicity":
            assert sum(labels.get(i, 0) for i in gone) >= 0.6 * sum(labels.values())
        if name == "quality":
            assert gone == quality & before
        if name == "near_dedup":
            comps = near_dup.near_duplicates(docs.where(docs.doc_id.isin(list(before))), 5, 80).collect()
            assert after == {r.component_id for r in comps}
    packed = P.STAGES[-1][1](spark, now, FITTED)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == after


def test_toxicity_stage_on_small_tables(spark):
    """Few labels, and still texts are dropped: toxic ones, hardly any clean one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").subtract(P.drop_toxic(spark, docs, SF).select("doc_id")).collect()}
    assert sum(labels.get(i, 0) for i in gone) >= 2 and sum(labels.get(i) == 0 for i in gone) <= 3


@pytest.mark.parametrize("empty", [False, True])
def test_hard_rows_pass_every_stage(spark, empty):
    df = hard_docs(spark)
    df = df.limit(0) if empty else df
    for _, stage in P.STAGES[:-1]:
        df = P.staged(stage(spark, df, SF))
        assert "q_w" in df.columns
    assert P.STAGES[-1][1](spark, df, SF).count() >= 0
