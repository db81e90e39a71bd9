"""NumPy kernels against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataview.llm import byte_bpe, textkit
from strataview.llm.elias_fano import EliasFano, encode
from strataview.llm.queries import tokenizer

from .helpers import ALNUM, WORD, lower

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é\n\t '.1|$"), max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words(texts):
    for table, pattern in ((textkit.SPACED, WORD), (textkit.ALNUM, ALNUM)):
        w = textkit.words(pa.array(texts, pa.string()), table)
        want = [pattern.findall(lower(t or "")) for t in texts]
        assert w.counts().tolist() == [len(x) for x in want]
        flat = [x for t in want for x in t]
        assert len(set(w.hashes.tolist())) == len(set(flat))
        assert {a: b for a, b in zip(flat, w.hashes.tolist(), strict=True)} == dict(zip(flat, w.hashes.tolist(), strict=True))


def test_blocks_do_not_change_hashes(monkeypatch):
    t = pa.array(["alpha beta " * 3000, "gamma", "alpha " + "x" * 5000])
    want = textkit.words(t).hashes
    monkeypatch.setattr(textkit, "BLOCK", 100)
    assert (textkit.words(t).hashes == want).all() and want[0] == textkit.seeded("alpha")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=5))
def test_shingles(rows):
    w = textkit.words(pa.array([" ".join(r) for r in rows]))
    flat, first = textkit.shingles(w, 3)
    names = {}
    for r, a, b in zip(rows, first[:-1], first[1:], strict=True):
        want = {tuple(r[i : i + 3]) for i in range(len(r) - 2)} if len(r) >= 3 else {tuple(r)} if r else set()
        assert b - a == len(want)
        assert names.setdefault(frozenset(want), flat[a:b].tolist()) == flat[a:b].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=60, unique=True), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_elias_fano(values, probes):
    v = np.array(sorted(values), np.uint64)
    e = EliasFano(encode(v))
    q = np.concatenate([v, np.array(probes, np.uint64)])
    assert (e.get(np.arange(len(v))) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aBé1 \n\t'.!$ßs"), st.sampled_from([" ", "'", "\u00a0", "½", "漢", "😀", "\u0301", "\x1c"])), max_size=25), min_size=1, max_size=6))
def test_byte_bpe(library, texts):
    texts = [*texts, "don't I'll we'RE 'sun ''s", "<|endoftext|> x", "  a  b\n\n c "]
    n, ids = byte_bpe.encoder(tokenizer()).encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, n, strict=True):
        assert ids[at : at + k].tolist() == library.encode(t, add_special_tokens=False).ids
        at += k


def test_long_texts_are_cut_safely(library, monkeypatch):
    monkeypatch.setattr(byte_bpe.cuts, "__defaults__", (50,))
    t = "Some longer text, with numbers 12 345 and it's   spaced\n\noddly. " * 30
    n, ids = byte_bpe.encoder(tokenizer()).encode(pa.array([t, "x", t]))
    want = library.encode(t, add_special_tokens=False).ids
    assert n.tolist() == [len(want), 1, len(want)] and ids[: len(want)].tolist() == want


def test_cache_may_be_full(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    e = byte_bpe.Encoder(tokenizer())
    for t in ("a b c d", "e f g h i j k", "a b c"):
        n, ids = e.encode(pa.array([t]))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
