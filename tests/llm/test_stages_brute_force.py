"""Every stage of the pipeline against a plain version of what it must do, on its own input."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from strataview.llm import quality_rules, toxicity
from strataview.llm.queries import tokenizer
from strataview.llm.shared import held_out, scratch

from .helpers import ALNUM, SF, WORD, hard_docs, lower
from .test_operators import brute_components, brute_quality, brute_spans

STOP = set(quality_rules.STOP_WORDS)


def plain_quality(text):
    """The threshold table, word by word."""
    n, chars, symbols, dup, repeated = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    stop = sum(w in STOP for w in WORD.findall(text or ""))
    return n >= 20 and repeated <= 0.3 * n and 1.5 <= chars / n <= 20 and symbols <= 0.25 * n and dup <= 0.5 * len(lines) and stop >= 0.02 * n


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        after = P.staged(stage(spark, now, SF))
        out[name] = (now.collect(), after.collect(), after.columns)
        now = after
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_toxicity_stage(spark, stages):
    before, after, _ = stages["toxicity"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out("doc_id", 4, 2)))
    score = {r.doc_id: model.score(pa.array([r.text]))[0] for r in before}
    assert set(texts(after)) == {i for i, s in score.items() if s < 0.3} != set(texts(before))


def test_quality_stage(stages):
    before, after, columns = stages["quality"]
    assert set(texts(after)) == {i for i, t in texts(before).items() if plain_quality(t)} != set(texts(before)) and columns == before[0].__fields__


def test_near_dedup_stage(stages):
    before, after, _ = stages["near_dedup"]
    comps, _ = brute_components(texts(before), 5, 80)
    assert set(texts(after)) == {c for i, c in comps.items()} and len(after) < len(before)


def test_decontaminate_stage(spark, stages):
    before, after, _ = stages["decontaminate"]
    words = lambda t: ALNUM.findall(lower(t or ""))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(texts(before)) - set(texts(after))
    for i, t in texts(before).items():
        w, text = words(t), " " + " ".join(words(t)) + " "
        if i in gone:
            assert any(brute_spans(x, w) <= int(0.2 * len(x)) for x in items), i
        else:
            assert not any(f" {' '.join(x)} " in text for x in items), i
    assert gone


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    before, pieces, _ = stages["pack"]
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length == 1 << p.bucket <= 2048 and p.start == len(found.setdefault(p.doc_id, []))
        found[p.doc_id] += ids
    assert found == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(before).items()}


def test_hard_rows_by_stage(spark):
    """What every stage makes of nulls, empty and long texts, repeats and clashing columns."""
    df = hard_docs(spark)
    rows = lambda d: Counter((r.doc_id, hash(r.text)) for r in d.collect())
    all_rows = rows(df)
    assert rows(P.drop_toxic(spark, df, SF)) == all_rows  # none of its ids is labelled toxic
    kept = rows(P.drop_low_quality(spark, df, SF))
    assert kept == Counter({k: n for k, n in all_rows.items() if k in {(r.doc_id, hash(r.text)) for r in df.collect() if plain_quality(r.text)}})
    one = P.drop_copies(spark, df, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one.select("doc_id").collect()) == sorted((i is None, i or 0) for i in [1, 2, 3, 4, 5, 7, 8, 9, None, 10])
    assert rows(P.drop_leaks(spark, df, SF)) == all_rows
    packed = P.pack(spark, df, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in df.select("doc_id").collect()}
    assert sum(r.length for r in packed.collect() if r.start == 0 and r.doc_id in (2, 3)) == 2  # null and empty: the end id alone


def test_scratch_is_removed(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = lambda df: Path(urlparse(df.inputFiles()[0]).path).parent
    with scratch() as keep:
        passing = folder(P.staged(spark.range(3)))
        out = keep(spark.range(5))
        assert passing.exists()
    assert not passing.exists() and folder(out).exists() and out.count() == 5


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from strataview.llm import shared

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, getCheckpointDir = "spark://far:7077", staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="must name a folder"):
        shared.shared_folder(Far)
