"""Each operator against brute force, and on hard inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataview.llm import decontaminate, license_scan, lm_score, near_dup, packing, quality_rules, sharding, textkit, token_counts, toxicity, url_filter
from strataview.llm.components import components
from strataview.llm.queries import URL_RULES, tokenizer
from strataview.llm.shared import held_out

from .helpers import ALNUM, SF, WORD, hard_docs, hard_texts, lower, no_docs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    return hard_docs(spark).cache()


# URL filter


def test_urls(spark):
    urls = {
        1: "https://WWW.Example.com/en/a?x", 2: "http://example.com/en/", 3: "http://a.net/es/b#c", 4: "http://a.net/de", 5: None, 6: "no-scheme/en/", 7: "http://x.org", 8: "http://com/",
        9: "http://example.com", 10: "http://notexample.com/en/", 11: "http://b.www.example.com/en/x", 12: "", 13: "http://é.net/fr/", 14: "a://b://net/es/",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id int, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df.unionByName(df), URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][1:] == ("/es/b", "net/es/", "block") and got[4][2:] == (None, "allow") and got[5] == got[6] == got[12] == ("", "", None, "allow")
    assert got[8][2] == "com/" and got[9] == ("example.com", "", None, "allow") and got[10][2] == "com/" and got[11][2] == "www.example.com/en/" and got[13][2] == "net/fr/"
    assert got[14][:2] == ("b:", "//net/es/")
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_urls_without_id_and_long_ones(spark):
    long = "https://" + "a." * 3000 + "www.example.com/en/" + "x/" * 200_000 + "?q#f"
    df = spark.createDataFrame([(None, "http://x.net/es/1"), (None, None), (1, long), (1, long)], "page_id long, url string")
    got = sorted(((r.page_id or 0, r.rule or "", r.verdict, len(r.host), len(r.path)) for r in url_filter.judge_urls(df, URL_RULES).collect()))
    assert got == [(0, "", "allow", 0, 0), (0, "net/es/", "block", 5, 5)] + [(1, "www.example.com/en/", "allow", 6015, 400_004)] * 2


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: 7)
    uri = url_filter.build_index(str(tmp_path / "i"), [("block", "a.com", "/"), ("allow", "b.com", "/x"), ("block", "com", "/")])
    got = url_filter.find(url_filter.map_file(uri), [("b.com", "/xy"), ("b.com", "/y"), ("a.com", "/"), ("c.org", "/")])
    assert got == [("b.com/x", False), ("com/", True), ("a.com/", True), (None, False)]


def test_empty_index(tmp_path):
    uri = url_filter.build_index(str(tmp_path / "i"), [])
    assert url_filter.find(url_filter.map_file(uri), [("a.com", "/")]) == [(None, False)]


# Language model


def test_lm(spark, docs, monkeypatch):
    """Order three by plain counting; many shards, hot contexts and hot pairs dealt over buckets."""
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 400)
    part = docs.where("doc_id < 60")
    model = lm_score.train(part.where("doc_id % 3 > 0"))
    assert len(model.vocabulary.sizes) > 1 and len(model.pairs.buckets.hot) > 2 and max(model.triples.buckets.parts) > 1 and len(model.triples.sizes) > 20
    got = {r.doc_id: r for r in lm_score.lm_score(part, model).collect()}
    c, bi, tri = Counter(), Counter(), Counter()
    seqs = {r.doc_id: [*WORD.findall(lower(r.text)), "</s>"] for r in part.collect()}
    for i, w in seqs.items():
        if i % 3:
            c.update(w)
            bi.update(zip(["</s>", *w], w, strict=False))
            tri.update(zip(["</s>", *w], w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    assert (model.vocabulary.total, model.pairs.sizes.sum(), model.triples.sizes.sum()) == (v, len(bi), len(tri))
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (bi[a, w] + lm_score.M2 * p1(w)) / (c[a] + lm_score.M2) if c[a] else p1(w)
    p3 = lambda a, b, w: (tri[a, b, w] + lm_score.M3 * p2(b, w)) / (bi[a, b] + lm_score.M3) if bi[a, b] else p2(b, w)
    for i, w in seqs.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        want = math.log10(p2("</s>", w[0])) + sum(math.log10(p3(a, b, x)) for a, b, x in zip(["</s>", *w], w, w[1:], strict=False))
        assert abs(r.score - want) < 2 * len(w) / lm_score.QUANT


def test_lm_sums_to_one(spark):
    """Over the vocabulary and one unknown word, after a seen pair, a seen word, and an unknown one."""
    rows = spark.createDataFrame([(1, "a b c a b d"), (2, "b c b"), (3, None)], "doc_id long, text string")
    model = lm_score.train(rows)
    for context in ("a b", "c d", "zz zz"):
        before, words = without_end(model, context.split()), [f"{context} {w}" for w in ("a", "b", "c", "d", "unseen")]
        total = sum(10 ** (without_end(model, t.split()) - before) for t in words) + 10 ** (model.score(pa.array([context]))["score"][0] - before)
        assert total == pytest.approx(1.0, abs=0.002), context


def without_end(model, words):
    """log10 probability of the words alone: the text's score less that of its end token."""
    h, first = lm_score.tokens(pa.array([" ".join(words)]))
    v = model.vocabulary
    keep = model.score(pa.array([" ".join(words)]))["score"][0]
    t = model.nodes(h, first)
    pair = t["node"][-2] if len(words) else -1
    end = len(h) - 1
    count, prob, weight = (x[t["of"]] for x in v.columns(t["u"], "count", "prob", "back"))
    p1 = prob[end] if count[end] else v.unigram(np.zeros(1))[0]
    logp = t["prob"][end] if t["node"][end] >= 0 else p1 + (weight[end - 1] if t["context"][end] >= 0 else 0.0)
    if pair >= 0:
        node, prob, _ = model.triples.find(np.array([pair]), np.array([t["id"][end]]))
        logp = prob[0] if node[0] >= 0 else logp + t["back"][end - 1]
    return keep - logp


def test_lm_hard(spark, hard):
    model = lm_score.train(hard)
    assert sorted(r.n_tokens for r in lm_score.lm_score(hard, model).collect()) == sorted(len(WORD.findall(t or "")) + 1 for _, t in hard_texts())
    empty = lm_score.train(no_docs(spark))
    r = lm_score.lm_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score and lm_score.lm_score(no_docs(spark), model).count() == 0


# Near duplicates


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    """Chains of edits, a shared passage, exact copies; links at and beside the threshold."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(5000)}"
    texts, passage = {}, [word() for _ in range(60)]
    for g in range(6):
        base = [word() for _ in range(int(rng.integers(40, 160)))]
        for k in range(9):
            w = list(base)
            for _ in range(k % 5):
                w[int(rng.integers(len(w)))] = word()
            texts[len(texts)] = " ".join(w)
            if k % 3 == 0:
                base = w
    for _ in range(8):
        texts[len(texts)] = " ".join([word() for _ in range(30)] + passage)
    texts |= {900: texts[3], 901: texts[3].upper(), 902: "short one", 903: "Short One", 904: "", 905: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, sizes = brute_components(texts, n, percent)
    got = near_dup.near_duplicates(df, n, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_hard(spark, hard):
    got = near_dup.near_duplicates(hard, 3, 85).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept, r.n_shingles))
    assert len(got) == len(hard_texts()) and by[1] == [(1, True, 10)] * 2 and by[11] == [(1, False, 10)] and by[6][0][0] == 5
    assert by[2] == [(2, True, 0)] and by[3] == [(3, True, 0)] and by[None][0][:2] == (None, True)
    assert near_dup.near_duplicates(no_docs(spark)).count() == 0


def test_drop_near_duplicates_hard(spark, hard):
    kept = near_dup.drop_near_duplicates(hard, 3, 85)
    assert kept.columns == hard.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 2, 3, 4, 5, 7, 8, 9, None, 10])


def test_signature_guarantee():
    """Any two signatures within the distance share a key."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        m = rng.integers(0, 1 << 63, (2, near_dup.SYMBOLS), dtype=np.uint64)
        m[1] = m[0]
        at = rng.choice(near_dup.SYMBOLS, near_dup.MAX_DISTANCE, replace=False)
        m[1, at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        k = near_dup.keys_of(m)
        assert (k[0] == k[1]).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 99), (99, 101), (200, 200), (5, 3), (7, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[300] == 0 and got[101] == got[100] == 99 and 200 not in got


# Tokens and packing


def test_token_counts(docs, library):
    got = {r.doc_id: r for r in token_counts.token_counts(docs.limit(60), tokenizer()).collect()}
    for r in docs.limit(60).collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 1024)


def test_token_counts_hard(spark, hard, library):
    got = sorted(r.n_tokens for r in token_counts.token_counts(hard, tokenizer()).collect())
    assert got == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in hard_texts())
    assert token_counts.token_counts(no_docs(spark), tokenizer()).count() == 0


def test_decompose():
    n = np.array([1, 2, 3, 7, 2047, 2048, 2049, 5000])
    size, counts = packing.decompose(n, 2048)
    at = 0
    for k, c in zip(n, counts, strict=True):
        part = size[at : at + c].tolist()
        assert sum(part) == k and part == sorted(part, reverse=True) and all(x & (x - 1) == 0 for x in part)
        assert len(set(x for x in part if x < 2048)) == len([x for x in part if x < 2048])
        at += c


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_packing_round_trip(request, which, library):
    df = request.getfixturevalue(which).limit(60)
    texts = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in df.collect())
    pieces = packing.pack(df, tokenizer()).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 and p.length == 1 << p.bucket for p in pieces)
    found, ids, last = Counter(), [], None
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        part = np.frombuffer(bytes(p.ids), "<u4")
        assert len(part) == p.length <= 2048
        assert p.start == len(ids) and (not ids or p.doc_id == last)
        ids, last = [*ids, *part.tolist()], p.doc_id
        if len(ids) == p.doc_tokens:
            found[p.doc_id, tuple(ids)] += 1
            ids = []
    assert not ids and found == texts


def test_packing_empty(spark, tmp_path, docs):
    assert packing.pack(no_docs(spark), tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer(), 1000)
    packing.write_buckets(packing.pack(docs.limit(5), tokenizer()), str(tmp_path / "b"))
    assert any((tmp_path / "b").glob("bucket=*"))


# Toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(d, y.where("doc_id % 4 <> 2")), d, y


def test_toxicity_on_held_out_rows(toxic_model):
    model, d, y = toxic_model
    got = toxicity.toxicity(d, model).join(y, "doc_id").where("doc_id % 4 = 2").toPandas()
    pos, neg = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]) > 0.95
    assert ((neg >= 0.3).mean()) < 0.05 and got.score.between(0, 1).all()


def test_toxicity_hard(spark, hard, toxic_model):
    got = toxicity.toxicity(hard, toxic_model[0]).collect()
    assert len(got) == len(hard_texts()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and toxicity.toxicity(no_docs(spark), toxic_model[0]).count() == 0


def test_toxicity_without_labels(spark, hard):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(hard, toxicity.fit(hard, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(hard, toxicity.fit(hard, one)).collect()} == {1.0}


def test_toxicity_with_few_labels(spark, docs):
    """Both classes occur, so the model is fitted; it tells them apart on the rows it has seen."""
    y = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out("doc_id", 4, 2))
    assert 0 < y.where("toxic = 1").count() < 10
    model = toxicity.fit(docs, y)
    got = toxicity.toxicity(docs, model).join(y, "doc_id").toPandas()
    pos, neg = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert (pos >= 0.3).sum() >= 2 and (neg >= 0.3).mean() < 0.05 and pos.mean() > 2 * neg.mean()
    one = y.where("toxic = 1").limit(1).unionByName(y.where("toxic = 0"))
    assert toxicity.toxicity(docs, toxicity.fit(docs, one)).select("score").distinct().count() > 1


def test_rare_toxic_labels_get_into_the_bounded_sample(toxic_model):
    _, d, y = toxic_model
    rows = y.where("doc_id % 4 <> 2").orderBy("doc_id")
    rare = rows.where("toxic = 1").limit(30).unionByName(rows.where("toxic = 0").limit(3000))
    got = toxicity.toxicity(d, toxicity.fit(d, rare, max_train=200)).join(y, "doc_id").where("doc_id % 4 = 2").toPandas()
    pos, neg = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]) > 0.85
    assert (pos >= 0.3).mean() > 0.3 and (neg >= 0.3).mean() < 0.05 and neg.mean() < 0.03


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) > 0).all() and y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_obfuscated_words_count():
    lex = toxicity.Lexicon(np.sort(np.array([textkit.words(pa.array(["moron"]), textkit.ALNUM).hashes[0]])), np.array([5.0]))
    f = toxicity.features(pa.array(["you m0r0n", "you moron", "you melon", ""]), [lex])[0]
    assert f[0, -2] == 1 and f[1, -2] == 0 and f[1, -3] > f[2, -3] == 0 and f[3].sum() == 0


# Sharding


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.interleave(df, 16).toPandas()
    rows = df.select("doc_id", "text").collect()
    assert Counter((None if i != i else i, s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows
    )
    counts = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    if which == "docs":
        share = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
        assert (share.max(axis=1) - share.min(axis=1)).max() <= 2


def test_sharding_empty(spark):
    assert sharding.interleave(no_docs(spark)).count() == 0


# License scan


def meets(own, t):
    """Whether a block's words meet a template, and hold what is its own and nothing that is another's."""
    words = set(ALNUM.findall(lower(t.text)))
    return len(own & words) >= license_scan.THRESHOLD * len(words) - 1e-9 and set(t.must.split()) <= own and not set(t.never.split()) & own


def brute_scan(text):
    w = ALNUM.findall(lower(text or ""))
    places = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    labels = {x for _, x in places}
    for line in (text or "").split("\n"):
        own = set(ALNUM.findall(lower(line)))
        labels |= {t.label for t in license_scan.TEMPLATES if meets(own, t)}
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


@pytest.mark.parametrize("which", ["docs", "hard", "made"])
def test_license_scan(spark, request, which):
    if which == "made":
        lines = ["All rights reserved.\nx", "all rights\nreserved", "Released MIT License the under", "a cc by cc by-nc 4.0 licensed under b", "general public license " * 3]
        lines += [t.text[: len(t.text) * k // 5] for t in license_scan.TEMPLATES for k in (3, 4, 5)]
        df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    else:
        df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(df).collect())
    assert got == Counter((r.doc_id, *brute_scan(r.text)) for r in df.select("doc_id", "text").collect())


def test_license_scan_empty(spark):
    assert license_scan.scan(no_docs(spark)).count() == 0


# Quality rules


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(df).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in df.select("doc_id", "text").collect())


def test_quality_filter_keeps_columns(spark, hard):
    kept = quality_rules.keep_quality(hard)
    assert kept.columns == hard.columns and kept.count() == 0 or {r.doc_id for r in kept.collect()} <= {5, 6}
    assert quality_rules.keep_quality(no_docs(spark)).count() == 0 and quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_quality_is_one_projection_without_functions_of_ours(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Decontamination


def test_contaminated(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, ALNUM.findall(lower(r.text))) for r in bench.collect()]
    for r in docs.collect():
        w = ALNUM.findall(lower(r.text))
        for i, x in items:
            if len(x) >= decontaminate.MIN_WORDS and any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1)):
                assert got[r.doc_id, i] == 0


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a, b = (rng.integers(0, 4, int(rng.integers(1, 9))).astype(np.uint64) for _ in range(2))
        for most in (1, 3, 9):
            assert decontaminate.edit_distance(a, b, most) == min(brute_edit(a.tolist(), b.tolist()), most + 1)


def brute_spans(item, text):
    """Least edits from an item to any span of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_recall_at_the_edit_threshold(spark):
    """Passages edited up to the threshold are found; precision is exact, as every match is verified."""
    rng = np.random.default_rng(4)
    items = {i: [f"t{rng.integers(900)}" for _ in range(int(rng.integers(12, 45)))] for i in range(25)}
    docs, truth = [], {}
    for i, w in items.items():
        for share in (0.0, 0.1, 0.2):
            v = list(w)
            for _ in range(int(share * len(w))):
                op, p = rng.integers(3), int(rng.integers(len(v)))
                v[p : p + (op > 0)] = [] if op == 1 else [f"z{rng.integers(10**6)}"]
            doc = [f"u{rng.integers(900)}" for _ in range(20)] + v + [f"u{rng.integers(900)}" for _ in range(20)]
            if (d := brute_spans(w, doc)) <= int(0.2 * len(w)):
                truth[len(docs), i] = d
            docs.append((len(docs), " ".join(doc)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items.items()], "item_id int, text string"))
    found = {(r.doc_id, r.item_id): r.edits for r in got.collect()}
    assert len(truth) == 75 and found.items() <= truth.items() and len(found) >= 0.95 * len(truth) and {(3 * i, i) for i in items} <= set(found)


def test_contaminated_hard(spark, hard):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "too short"), (1, "quick brown fox jumps over the lazy dog")], "item_id int, text string")
    got = decontaminate.contaminated(hard, bench.withColumn("doc_id", F.lit(1))).collect()
    assert Counter((r.doc_id, r.item_id, r.edits) for r in got) == Counter({(1, 1, 0): 4, (11, 1, 0): 2})
    assert decontaminate.contaminated(no_docs(spark), bench).count() == 0 and decontaminate.contaminated(hard, bench.limit(0)).count() == 0


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Buckets dealt into many blocks give the pairs that all comparisons within them give, each once."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, near_dup.SKETCH // 64)
    rows = []
    for k in range(60):
        sketch = base.copy()
        for bit in rng.choice(near_dup.SKETCH, int(rng.integers(20, 160)), replace=False):
            sketch[bit // 64] ^= 1 << (int(bit) % 63)
        keys = [7 if k % 5 else 100 + k, 8 if k % 3 else 200 + k, *(1000 * k + j for j in range(2, near_dup.SYMBOLS))]
        rows += [(7 + i, k, k % 4, int(90 + k % 30), keys, i, *map(int, sketch)) for i in (0, 1) if keys[i] == 7 + i]
    columns = ["key", "cls", "comp", "n", "keys", "i", *near_dup._S]
    kinds = "key long, cls long, comp long, n long, keys array<long>, i int, " + ", ".join(f"{c} long" for c in near_dup._S)
    got = sorted(tuple(r) for r in near_dup._within(spark.createDataFrame(rows, kinds), 85).collect())
    want = set()
    for x in rows:
        for y in rows:
            x_, y_ = dict(zip(columns, x, strict=True)), dict(zip(columns, y, strict=True))
            differ = sum(((x_[c] ^ y_[c]) & (1 << 64) - 1).bit_count() for c in near_dup._S)
            sized = 100 * min(x_["n"], y_["n"]) >= 85 * max(x_["n"], y_["n"])
            if x_["key"] == y_["key"] and x_["cls"] < y_["cls"] and x_["comp"] != y_["comp"] and sized and differ <= near_dup._most(85):
                want.add((x_["cls"], y_["cls"]))
    assert got == sorted(want) and len(want) > 50
