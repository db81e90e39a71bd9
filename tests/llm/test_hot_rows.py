"""Ids, texts and labels that hold most of a table."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataview.llm import sharding, textkit, toxicity
from strataview.llm.queries import op6_toxicity

from .helpers import lower, no_docs


def test_shards_of_a_hot_id(spark):
    """100,000 rows of one id and text, as many null ids of one text, and one id with many texts."""
    n = 100_000
    same = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("source"))
    nulls = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("b").alias("source"))
    texts = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    got = sharding.interleave(same.unionByName(nulls).unionByName(texts), 16)
    total = 2 * n + 5000
    by = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("k")).collect()
    assert sorted(r.shard for r in by) == list(range(16)) and sum(r.n for r in by) == total
    assert max(r.n for r in by) - min(r.n for r in by) <= 1 and all((r.lo, r.hi, r.k) == (0, r.n - 1, r.n) for r in by)
    assert got.select("position").distinct().count() == total
    share = got.groupBy("source", "shard").count().groupBy("source").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 2 for r in share)
    kept = {(r.doc_id, r.text_crc32): r["count"] for r in got.where("source is not null").groupBy("doc_id", "text_crc32").count().collect()}
    assert sorted(kept.values()) == [n, n]


def test_a_hot_labelled_id_is_fitted_on_once(spark, monkeypatch):
    """One label and 20,000 rows of its id: one of them is fitted on."""
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(50, size=30)) + (" vile brute" if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hot = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("vile brute "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.Trees.fit
    monkeypatch.setattr(toxicity.Trees, "fit", lambda self, x, y: seen.append(len(y)) or fit(self, x, y))
    model = toxicity.fit(df.where("doc_id <> 3").unionByName(hot), labels)
    assert max(seen) == 60
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, model).collect()}
    assert min(got[i] for i in range(0, 60, 3)) > max(got[i] for i in range(60) if i % 3)


def brute_features(text, lexicon, cuts=toxicity.CUTS):
    """The features of one text by plain Python; ``lexicon`` maps a word or a head of it to its odds."""
    alnum = lambda c: c.isascii() and c.isalnum() or ord(c) > 127
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
    n, size = max(1, len(words)), max(1, len(text.encode()))
    letters = sum(c.isascii() and c.isalpha() or (ord(c) > 127) * len(c.encode()) for c in text)

    def odds(w):
        return max([lexicon.get(w, 0.0)] + [lexicon.get((w[:k], k), 0.0) for k in cuts if len(w) > k])

    low = [lower(w) for w in words]
    o = [odds(w) for w in low]
    you = [k for k, w in enumerate(low) if w in toxicity.YOU]
    odd = set("0123456789@$*!")
    caps = sum("A" <= c <= "Z" for c in text)
    out = [
        np.log1p(len(words)), sum(w.isascii() and w.isalpha() and w.isupper() and len(w) > 1 for w in words) / n, caps / max(1, letters),
        sum(c in "!?" for c in text) / size, sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text) / size,
        sum(text[k] in odd and text[k - 1].isalpha() and text[k + 1].isalpha() for k in range(1, len(text) - 1)) / n, len(you) / n,
    ]
    for lo, hi in ((0, 2.0), (2.0, 3.5), (3.5, 99.0)):
        c = sum(lo < x <= hi for x in o)
        out += [c, c / n]
    total = sum(o)
    near = sum(any(abs(k - j) <= toxicity.NEAR for j in you) and x > 2 for k, x in enumerate(o))
    plain = lambda w: "".join(toxicity.LEET.get(c, c) for c in w)
    runs = re.findall(r"[0-9A-Za-z\x80-\U0010ffff@$!]+", text)
    hidden = sum(odds(lower(plain(w))) > 2 for w in runs if any(c in odd for c in w))
    assert all(alnum(c) for w in words for c in w)
    return out + [max(o, default=0.0), total, total / n, np.sqrt(total / n), len({w for w, x in zip(low, o, strict=True) if x > 2}), near, near / n, hidden, hidden / n]


def test_features_against_brute_force():
    words = {"moron": 5.0, "idiot": 2.5, "silly": 1.5, "filth": 3.0}
    heads = {("scum", 4): 4.0, ("hatefu", 6): 2.2}
    entries = [(textkit.seeded(w), x) for w, x in words.items()] + [(textkit.seeded(w) ^ k, x) for (w, k), x in heads.items()]
    keys, odds = zip(*sorted(entries), strict=True)
    lex = toxicity.Lexicon(np.array(keys, np.uint64), np.array(odds))
    rng = np.random.default_rng(1)
    stock = ["moron", "IDIOT", "1d10t", "silly", "filth!", "scumbag", "scum", "hateful", "you", "YOUR", "m0r0n", "été", "über", "the", "a", "x9y", "Hello,", "NO", "wow!?", "f1lth", "$illy", "tú", "--"]
    texts = ["", "   ", "moron", "you m0r0n"] + [" ".join(rng.choice(stock, int(rng.integers(1, 40)))) for _ in range(200)]
    got = toxicity.features(pa.array(texts), [lex])[0]
    for t, g in zip(texts, got, strict=True):
        assert g == pytest.approx(brute_features(t, {**words, **heads})), t


def test_the_query_learns_and_holds_out_by_its_contract(spark):
    """Held out by crc32 of the id; scores of rows it never saw tell the classes apart."""
    import zlib

    sf = "/root/testdata/sf0.1"
    got = op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    pos, neg = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    assert np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) > 0.97 and (pos >= 0.3).mean() > 0.85 and (neg >= 0.3).mean() < 0.02


def test_no_rows(spark):
    assert sharding.interleave(no_docs(spark), 3).count() == 0
