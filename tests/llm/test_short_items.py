"""Benchmark items too short for the edit search match word for word."""

import numpy as np
from pyspark.sql import functions as F

from strataview.llm import decontaminate

from .helpers import ALNUM, hard_docs, lower


def test_short_items_against_brute_force(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(30, size=n))
    items = [(k, say(1 + k % 7)) for k in range(42)] + [(42, say(7)), (43, "What is the capital city of France?"), (43, "what is the capital city of France"), (44, ""), (45, None), (46, say(12))]
    docs = [(k, say(40)) for k in range(60)]
    docs += [(60, "Q: what IS the capital, city of France? A: Paris"), (61, "what is the capital city of"), (62, "France what is the capital city of Spain"), (63, items[42][1]), (64, items[47][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    got = decontaminate.contaminated(df, bench).collect()
    words = lambda t: ALNUM.findall(lower(t or ""))
    want = []
    for d, text in docs:
        w = words(text)
        for i, t in items:
            x = words(t)
            at = [k for k in range(len(w) - len(x) + 1) if w[k : k + len(x)] == x]
            if 0 < len(x) < decontaminate.MIN_WORDS and at:
                want.append((d, i, at[0], len(x), 0))
    assert sorted(tuple(r) for r in got if r.item_id != 46) == sorted(want) and len(want) > 50
    assert [(d, i) for d, i, *_ in want if i == 43] == [(60, 43), (60, 43)] and any(r.doc_id == 64 and r.item_id == 46 for r in got)
    leaked = {r.doc_id for r in df.where(decontaminate.is_contaminated(F.col("text"), bench)).collect()}
    assert leaked == {r.doc_id for r in got}


def test_short_items_alone(spark):
    bench = spark.createDataFrame([(1, "the lazy dog")], "item_id int, text string")
    got = decontaminate.contaminated(hard_docs(spark), bench).collect()
    assert sorted((r.doc_id, r.first_word, r.edits) for r in got) == [(1, 6, 0), (1, 6, 0), (11, 6, 0)]
