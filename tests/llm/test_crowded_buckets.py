"""Buckets full of texts that share a passage and little else, and a large group beside strays."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataview.llm import near_dup

from .test_operators import brute_components


def boilerplate(rng, count, shared, own):
    passage = [f"p{k}" for k in range(shared)]
    return [" ".join(passage + [f"w{x}" for x in rng.integers(10**6, size=own)]) for _ in range(count)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "CROWDED", 16)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_crowded_buckets_lose_no_link(spark, small, n, percent, monkeypatch):
    """Hundreds of texts with one long passage, near copies planted among them."""
    rng = np.random.default_rng(n)
    texts = boilerplate(rng, 160, 60, 45)
    for k in range(0, 60, 3):
        w = texts[k].split()
        for p in rng.integers(60, len(w), size=1 + k % 3):
            w[int(p)] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(w))
    base = texts[0].split()
    for _ in range(60):  # one large group of near copies
        w = list(base)
        w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(w))
    order = rng.permutation(len(texts))
    texts = {int(i): t for i, t in zip(order, texts, strict=True)}
    used = []
    fine = near_dup.fine_keys
    monkeypatch.setattr(near_dup, "fine_keys", lambda *a: used.append(1) or fine(*a))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, _ = brute_components(texts, n, percent)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, n, percent).collect()} == want and used


def test_copies_grow_with_the_members(spark, small, monkeypatch):
    """Rows dealt into blocks, for twice the texts with one passage: about twice, not four times."""
    dealt = []
    within = near_dup._within
    monkeypatch.setattr(near_dup, "_within", lambda filed, percent: dealt.append(filed.count()) or within(filed, percent))
    for count in (150, 300):
        texts = boilerplate(np.random.default_rng(1), count, 60, 60)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = near_dup.near_duplicates(df, 3, 85)
        assert got.where("kept").count() == count
    assert dealt[1] < 2.6 * max(1, dealt[0])


def test_strays_beside_a_large_component(spark, monkeypatch):
    """Members of the largest component are never dealt against each other."""
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    rows = [(7, k, 0 if k < 300 else k, 100, *([0] * (near_dup.SKETCH // 64))) for k in range(305)]
    kinds = "key long, cls long, comp long, n long, " + ", ".join(f"{c} long" for c in near_dup._S)
    filed = spark.createDataFrame(rows, kinds)
    shape = near_dup._shape(filed).first()
    assert (shape.main, shape.others, shape.strays, shape.mains) == (0, 5, 1, 30)
    got = {tuple(r) for r in near_dup._within(filed, 85).collect()}
    assert got == {(a, b) for b in range(300, 305) for a in range(b)} and len(got) == 5 * 300 + 10
    assert near_dup._shape(filed.where(F.col("comp") == 0)).count() == 0


def test_sketches_differ_in_their_bits_whatever_the_sign():
    """Words that differ in their highest and lowest bits are two bits apart, though their difference is negative."""
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, (20, near_dup.SKETCH // 64))
    y = x.copy()
    for k in range(len(y)):  # row k in k words
        y[k, :k] ^= np.int64(-(1 << 63) | 1)
    u, v = near_dup._alike(x, y, 10)
    assert u.tolist() == v.tolist() == [0, 1, 2, 3, 4, 5]


def near_a_group(rng, n, percent):
    """A group's texts, and copies whose similarity to its first one is just above the threshold."""
    base = [f"w{k}" for k in range(402)]
    spoilt = 400 * (100 - percent) // (100 + percent) // n  # words that spoil n shingles each
    out = [" ".join(base)]
    for size in [1] * 20 + [spoilt] * 20:
        w = list(base)
        for p in rng.permutation(np.arange(n, 400 - n, n))[:size]:
            w[int(p)] = f"e{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out[:21], out[21:]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_copies_meet_a_larger_group(spark, n, percent):
    """In one bucket, every copy at the threshold is paired with the group's first text."""
    group, near = near_a_group(np.random.default_rng(n), n, percent)
    sets = {}
    for t in group + near:
        w = t.split()
        sets[int(near_dup.class_of(*near_dup._full(pa.array([t]), n)[:2]).view(np.int64)[0])] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    cls = list(sets)
    top = cls[0]
    assert all(100 * len(sets[top] & sets[c]) >= percent * len(sets[top] | sets[c]) for c in cls)
    comp = spark.createDataFrame([(7, c, top if k < len(group) else c) for k, c in enumerate(cls)], "key long, cls long, comp long")
    rows = near_dup.full_sets(spark.createDataFrame([(t,) for t in group + near], "text string"), n)
    got = {tuple(r) for r in near_dup._within(comp.join(rows.drop("shingles"), "cls"), percent).collect()}
    assert {(min(top, c), max(top, c)) for c in cls[len(group) :]} <= got


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_crowds_lose_no_link_by_chance(spark, small, n, percent, monkeypatch):
    """Copies that only a crowded bucket holds together meet, however few minima they share (one key of them here, where such keys are used)."""
    monkeypatch.setattr(near_dup, "FINE", 1, raising=False)
    monkeypatch.setattr(near_dup, "CROWDED", 0)
    monkeypatch.setattr(near_dup, "_may_link", lambda x, y, percent: F.lit(False))  # the steps before find no link
    rng = np.random.default_rng(n)
    texts = boilerplate(rng, 160, 60, 45)
    texts += [" ".join(f"e{rng.integers(10**6)}" if k == 104 else x for k, x in enumerate(t.split())) for t in texts[:60]]
    for k in range(60):  # words replaced from the end on, as many as the threshold allows
        w = texts[100 + k].split()
        w[len(w) - (103 + 1 - n) * (100 - percent) // (100 + percent) :] = []
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, _ = brute_components(dict(enumerate(texts)), n, percent)
    assert sum(want[k] != k for k in want) == 120
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, n, percent).collect()} == want


def test_prefixes_of_linked_sets_meet(spark):
    """Sets exactly at the threshold share a prefix shingle; shingles of one set alone are not filed."""
    rows = [(1, 20, [*range(20)]), (2, 17, [*range(3, 20)]), (3, 20, [*range(100, 120)]), (4, 23, [*range(100, 120), 201, 202, 203])]
    keys = near_dup.fine_keys(spark.createDataFrame(rows, "cls long, n long, shingles array<long>"), 85)
    got = {}
    for r in keys.collect():
        got.setdefault(r.cls, set()).add(r.key)
    assert got[1] & got[2] and set(got) == {1, 2, 3, 4}
    assert got[3] == {100, 101, 102, 103} and got[4] == {100}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_rows_grow_with_a_group_of_near_copies(spark, n, percent, monkeypatch):
    """Where the steps before find nothing, twice the near copies make about twice the rows, not four times."""
    monkeypatch.setattr(near_dup, "_may_link", lambda x, y, percent: F.lit(False))
    within, made = near_dup._within, []
    monkeypatch.setattr(near_dup, "_within", lambda *a: made.append(near_dup.staged(within(*a))) or made[-1])
    rng = np.random.default_rng(n)
    for count in (60, 120):
        texts = {0: " ".join(f"w{k}" for k in range(120))}
        for i in range(1, count):  # some link with all, some with a few, some with none
            w = texts[0].split()
            for p in rng.integers(120, size=1 + i % 4):
                w[int(p)] = f"e{rng.integers(10**9)}"
            texts[i] = " ".join(w)
        want, _ = brute_components(texts, n, percent)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, n, percent).collect()} == want
    assert made[1].count() < 2.6 * made[0].count()


def test_only_links_that_join_components_leave_two_blocks(spark):
    """Pairs of full sets in one bucket: each that links is joined, none twice, none below the threshold."""
    sets = [[*range(100)], [*range(1, 101)], [*range(2, 102)], [*range(14, 114)], [*range(500, 600)], [*range(505, 605)], [*range(900, 1000)]]
    rows = [(7, k, k, len(s), *([0] * (near_dup.SKETCH // 64)), s) for k, s in enumerate(sets)]
    kinds = "key long, cls long, comp long, n long, " + ", ".join(f"{c} long" for c in near_dup._S) + ", shingles array<long>"
    filed = spark.createDataFrame(rows, kinds)
    got = [tuple(r) for r in near_dup._within(filed, 85).collect()]
    assert len(got) == 3 and (4, 5) in got and {x for pair in got for x in pair} == {0, 1, 2, 4, 5}
    assert {r.cls for r in near_dup._met(filed.drop("shingles"), 85).collect()} == set(range(7))
