"""Look-ups of the trie: plain mapped arrays, membership by low bits, distinct pairs by one sort."""

import numpy as np
import pytest

from strataview.llm import lm_score
from strataview.llm.elias_fano import Children, EliasFano, encode, encode_children
from strataview.llm.shared import map_file, write_file


@pytest.mark.parametrize("top, n", [(1, 50), (40, 300), (10**6, 400), (1 << 62, 3), (1 << 62, 500), (0, 0)])
def test_find_reads_no_value_twice(tmp_path, monkeypatch, top, n):
    """Whether a value is there is known from its low bits; values are not selected again."""
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    write_file(str(tmp_path / "a.ef"), encode(values))
    arrays = map_file(str(tmp_path / "a.ef"))
    assert all(type(a) is np.ndarray for a in arrays.values())
    monkeypatch.setattr(EliasFano, "get", None)
    asked = np.sort(np.concatenate((values, values + np.uint64(1), rng.integers(0, 2 * top + 2, 200, dtype=np.uint64))))
    i, ok = EliasFano(arrays).find(asked)
    assert np.array_equal(i, np.searchsorted(values, asked)) and np.array_equal(ok, np.isin(asked, values))


def test_children_are_found_in_their_own_context():
    rng = np.random.default_rng(5)
    pairs = sorted({(int(c), int(s)) for c, s in zip(rng.integers(0, 40, 600), rng.integers(0, 50, 600), strict=True) if c % 7})
    c, s = (np.array(x) for x in zip(*pairs, strict=True))
    children = Children(encode_children(c, s.astype(np.uint64), 40))
    every = [(a, b) for a in range(40) for b in range(52)]
    i, ok = children.find(*(np.array(x).astype(k) for x, k in zip(zip(*every, strict=True), (np.int64, np.uint64), strict=True)))
    assert [p for p, o in zip(every, ok, strict=True) if o] == pairs and i[ok].tolist() == list(range(len(pairs)))


@pytest.mark.parametrize("limit", [7, 1 << 20, 1 << 30, 1 << 40])
def test_distinct_pairs(limit):
    """One sort of numbers, of keys beyond that, and of two columns."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, min(limit, 1 << 30), 40)[rng.integers(40, size=3000)], rng.integers(0, limit, 40)[rng.integers(40, size=3000)]
    x, y, of, n = lm_score.distinct(a, b, limit)
    want, at, count = np.unique(np.stack((a, b)), axis=1, return_inverse=True, return_counts=True)
    assert np.array_equal(want, (x, y)) and np.array_equal(at.ravel(), of) and np.array_equal(count, n)
    assert [len(z) for z in lm_score.distinct(a[:0], b[:0], limit)] == [0, 0, 0, 0]


def test_words_of():
    h = np.random.default_rng(4).integers(0, 1 << 64, 90, dtype=np.uint64)[np.random.default_rng(5).integers(90, size=2000)]
    for part in (h, h[:1], h[:0]):
        u, of = lm_score.words_of(part)
        assert np.array_equal(u, np.unique(part)) and np.array_equal(u[of], part)
