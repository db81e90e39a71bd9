"""Texts far beyond a batch: cut at safe places, counted and packed in bounded memory, ids as the library's."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strataview.llm import byte_bpe, packing, textkit, token_counts
from strataview.llm.queries import op5_packing, tokenizer

from .helpers import SF, hard_docs


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(tokenizer())


def mixed(rng, n):
    stock = ["the", " word", "  two", "\n\n", "it's", "don't", "we'll", "'s", " 'tis", "12", "3a4", "été", "漢字。", "<|endoftext|>", "a<|endoftext|>b", " ", "   ", "\t", "...", "x,y", "-", "😀", " \n", "naïve", "\x1c", "('", "end."]
    return "".join(rng.choice(stock, n))


def test_cut_texts_have_the_library_ids(encoder, monkeypatch):
    """Segments of a few bytes: every cut is put to the test."""
    rng = np.random.default_rng(0)
    texts = [mixed(rng, 400) for _ in range(60)] + ["x" * 5000, "漢字" * 2000, "ab,cd;12x" * 300, "", "<|endoftext|>" * 300]
    want = [encoder.whole(t).tolist() for t in texts]
    for segment in (16, 61, 256):
        monkeypatch.setattr(byte_bpe, "SEGMENT", segment)
        monkeypatch.setattr(byte_bpe, "GROUP", 3 * segment)
        data, offsets = textkit.buffers(pa.array(texts))
        seg, owner = byte_bpe.cuts(data, offsets, segment, encoder.added)
        assert len(owner) > 10 * len(texts) or segment > 61
        counts, ids = encoder.encode(pa.array(texts))
        ends = np.concatenate(([0], np.cumsum(counts)))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
        assert encoder.encode(pa.array(texts), ids=False)[0].tolist() == counts.tolist()


def test_colliding_pieces_are_told_apart(monkeypatch):
    """Hashes of three bits only: the bytes decide."""
    spans = textkit.span_hashes
    monkeypatch.setattr(byte_bpe.K, "span_hashes", lambda *a: spans(*a) & np.uint64(7))
    e = byte_bpe.Encoder(tokenizer())
    texts = ["a cat sat on a mat", "one two three four five six seven eight nine ten", "a cat", "", "the"]
    counts, ids = e.encode(pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in e.whole(t).tolist()] and counts.tolist() == [len(e.whole(t)) for t in texts]


def test_memory_of_a_long_text(encoder):
    """30 MB of text, some of its characters odd: a small share of its size beside it, and a little more than its ids to pack."""
    rng = np.random.default_rng(1)
    part = " ".join(rng.choice(["alpha", "beta's", "12", "gamma,", "été", " ", "漢", "delta.\n"], 60_000))
    text = pa.array([part * (30_000_000 // len(part.encode()))])
    encoder.encode(pa.array([part]))
    tracemalloc.start()
    counts, _ = encoder.encode(text, ids=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = text.nbytes // len(part.encode())
    assert peak < 150 << 20 and abs(int(counts[0]) - n * len(encoder.whole(part))) <= n


def test_long_text_is_packed_in_order(spark, encoder):
    text = "Some words, and more; it's 12 again. " * 300_000
    df = spark.createDataFrame([(1, "short"), (2, text), (3, None)], "doc_id long, text string")
    want = [*encoder.whole(text).tolist(), 1]
    pieces = sorted(packing.pack(df, tokenizer()).where("doc_id = 2").collect(), key=lambda p: p.start)
    assert sum(p.length for p in pieces) == len(want) == pieces[0].doc_tokens
    assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in pieces]).tolist() == want
    assert token_counts.token_counts(df, tokenizer()).where("doc_id = 2").first().n_tokens == len(want) - 1


def test_buckets_are_written_and_ids_stay(spark):
    """The query's sequences are one table: read twice they are the same, one folder a length."""
    got = op5_packing(spark, SF)
    first, second = ({(r.doc_id, r.start): r.sequence_id for r in got.collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == got.count()
    assert got.where("length != shiftleft(1, bucket)").count() == 0
    files = got.where("bucket = 3").inputFiles()
    assert files and all("bucket=" in f for f in files)
    assert packing.bucketed(packing.pack(hard_docs(spark).limit(0), tokenizer())).count() == 0
