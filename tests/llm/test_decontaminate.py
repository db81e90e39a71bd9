"""Recall by item length, memory, spans, and benchmarks of many parts, against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strataview.llm import decontaminate as D
from strataview.llm import textkit as K

from .helpers import hard_docs
from .test_operators import brute_edit, brute_spans


def search(items, docs, max_edits=0.2, min_words=8):
    """(document, item id) pairs, by the kernel alone."""
    part = D.Part(D.index(pa.array(range(len(items))), pa.array([" ".join(w) for w in items]), max_edits, min_words), max_edits)
    w = K.words(pa.array([" ".join(d) for d in docs]), K.ALNUM)
    ids, own = part.ids.to_pylist(), part.a["own"]
    return {(t, i): (p, n, d) for t, k, p, n, d in part.search(w, w.text_of()) for i in ids[own[k] : own[k + 1]]}


@pytest.mark.parametrize("n", [8, 12, 20, 45, 59, 100, 200, 400])
def test_recall_by_length_at_the_threshold(n):
    """As many edits as the threshold allows, of one kind at a time and mixed: 0.95 of the copies are found, at every length."""
    rng = np.random.default_rng(n)
    trials, filler = 40 if n <= 100 else 20, lambda k: [f"u{x}" for x in rng.integers(900, size=k)]
    for kind in range(4):  # put in, left out, replaced, mixed
        items = [[f"t{x}" for x in rng.zipf(1.3, n) % 3000] for _ in range(trials)]
        docs = []
        for w in items:
            v = list(w)
            for _ in range(int(0.2 * n)):
                op, p = kind if kind < 3 else int(rng.integers(3)), int(rng.integers(len(v)))
                v[p : p + (op > 0)] = [] if op == 1 else [f"z{rng.integers(10**6)}"]
            docs.append(filler(25) + v + filler(25))
        got = search(items, docs)
        assert sum((i, i) in got for i in range(trials)) >= 0.95 * trials, kind


def test_spans_are_exact():
    """Edits and spans of the best match, the ends free."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        item, text = rng.integers(0, 5, int(rng.integers(1, 9))), rng.integers(0, 5, int(rng.integers(0, 25)))
        most = int(rng.integers(0, 4))
        got = D.best_span(item.astype(np.uint64), text.astype(np.uint64), most)
        spans = [(brute_edit(item.tolist(), text[a:z].tolist()), z, z - a) for z in range(len(text) + 1) for a in range(z + 1)]
        edits, end, size = min(spans)
        assert edits == brute_spans(item.tolist(), text.tolist())
        assert got == ((edits, end - size, size) if edits <= most else None)


def test_twenty_thousand_items_in_little_memory():
    """A whole part of the benchmark is indexed and searched within 500 MB, and finds each planted item."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(600_000)])
    items = [words[rng.integers(len(words), size=int(rng.integers(15, 60)))].tolist() for _ in range(D.BLOCK)]
    docs = [items[k] if k % 2 else words[rng.integers(len(words), size=40)].tolist() for k in range(0, D.BLOCK, 101)]
    tracemalloc.start()
    got = search(items, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and {t for t, _ in got} == {t for t, k in enumerate(range(0, D.BLOCK, 101)) if k % 2}


def test_a_frequent_phrase_of_many_items():
    """Thousands of items open with one phrase that stands everywhere in the texts."""
    rng = np.random.default_rng(2)
    opening = "which one of the following statements is true about".split()
    items = [opening + [f"q{x}" for x in rng.integers(4000, size=14)] for _ in range(3000)]
    docs = [opening * 50 + [f"u{x}" for x in rng.integers(4000, size=60)] for _ in range(20)] + [["x"] * 5 + items[7] + opening, opening + items[8][9:20]]
    got = search(items, docs)
    assert got[20, 7] == (5, 23, 0) and got[21, 8][2] == 3 and {t for t, _ in got} == {20, 21}


def test_windows_that_share_no_key():
    """An unchanged run names windows among known words, and no item is near any."""
    item = [f"b{j}" for j in range(20)]
    assert search([item], [item[4:8] + list(reversed(item))]) == {}


def test_parts_and_named_columns(spark):
    """Many parts, ids and texts under other names; equal items report each; one pass over the documents."""
    items = [(f"i{k}", " ".join(f"b{(k % 30) * 40 + j}" for j in range(15))) for k in range(60)]
    bench = spark.createDataFrame(items, "key string, body string").repartition(5)
    docs = spark.createDataFrame([(k, f"x y {items[k][1]} z") for k in range(30)] + [(99, "nothing here")], "doc_id long, text string")
    files = D.write_index(bench, id_col="key", text_col="body", block=7)
    assert len(files) >= 9
    got = D.contaminated(docs, bench, item_col="key", item_text_col="body")
    assert sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.edits) for r in got.collect()) == sorted((k % 30, f"i{k}", 2, 15, 0) for k in range(60))
    assert got.columns == ["doc_id", "item_id", "first_word", "n_words", "edits"]
    kept = docs.where(~D.is_contaminated(docs.text, bench, item_col="key", item_text_col="body"))
    assert [r.doc_id for r in kept.collect()] == [99]


def test_ties_and_ends(spark):
    """Of equally good places the first; matches at both ends of a text and in a text shorter than the item."""
    item = [f"b{j}" for j in range(20)]
    far = ["x"] * 40
    got = search([item], [item + far + item, far + item, item[:16], item[4:], far + item[2:18] + far, item[:15]])
    assert got == {(0, 0): (0, 20, 0), (1, 0): (40, 20, 0), (2, 0): (0, 16, 4), (3, 0): (0, 16, 4), (4, 0): (40, 16, 4)}


def test_short_items_beside_long_ones(spark):
    bench = spark.createDataFrame([(1, "brown fox jumps over the"), (2, "quick brown fox jumps over a lazy dog and again and")], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.contaminated(hard_docs(spark), bench).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 2), (1, 2, 2), (11, 1, 0), (11, 2, 2)]
