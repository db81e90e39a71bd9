"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

Texts with equal shingle sets form one class. A class has a signature of ``SYMBOLS``
b-bit minima (b = 32); two sets of similarity s differ in about (1 - s) * SYMBOLS of
them. The join finds every pair that differs in at most ``MAX_DISTANCE`` symbols: with
``CHUNKS`` chunks, by pigeonhole some chunk has at most MAX_DISTANCE // CHUNKS = 1 wrong
symbol, so a class is filed under every chunk with each one symbol left out. At
similarity 0.85 a pair exceeds that distance with a chance of 2e-6 (0.8: 2e-4), and is
found even then if one chunk agrees.

Buckets never emit all their pairs. First every member is compared with its bucket's
least member; the links that hold give components. In buckets that still hold several,
each member is then compared with the nearest few leaders of other components, each
bucket having a leader of its own. Last, exactly, all members of different components that
share a bucket are compared, two blocks of BLOCK members at a time, by set sizes and a
second, 2048-bit sketch (five standard deviations wide). Members of a bucket's largest
component meet the others only, never each other. No pair leaves a block: the first time
only the members that have a partner do, and these meet again with their full sets, where
each pair is confirmed unless links before it join its components, and only links that join
components leave. So the rows made grow with the members, and no link between components
is lost.

A bucket can be crowded by texts that aren't alike: a passage that many share gives them
the same few minima. Where more than CROWDED members stand outside the largest component,
the bucket's classes are filed anew, once each whatever their buckets, under the shingles of
their prefix: with the crowd's shingles ordered by how many of its sets hold them, the rarest
first, two sets at the threshold share one of the first n - ceil(percent * n / 100) + 1 of each,
as that many can't all be missing from the other. This is exact. Shingles that one set alone
holds are counted but not filed, so texts that share a passage and little else are hardly
filed at all. Each bucket of such keys is compared in full, whatever its size.
All joins are equi-joins that adaptive execution can split where a key is hot; links,
components and fingerprints stay in distributed tables.

Words are what white space separates, A-Z lower-cased. A text with fewer words than a
shingle has its whole sequence as its one shingle; a null text or one without words has
none, links with nothing and is a component of its own. Rows with equal ids stay separate
rows; null ids never name a component unless it has no other. Of the input only the id
and the text are read. An empty table gives no rows. Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .components import components
from .shared import small_batches, staged, texts

SYMBOLS, CHUNKS, MAX_DISTANCE = 32, 8, 15
SKETCH = 2048
NEAREST, PASSES = 3, 1
BLOCK = 512
SHINGLES = 1 << 18  # of a block's full sets
CROWDED = 4 * BLOCK
_rng = np.random.default_rng(71)
_A = _rng.integers(1, 1 << 62, SYMBOLS + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = _rng.integers(1, 1 << 63, SYMBOLS + SKETCH, dtype=np.uint64)
_SIDE = SYMBOLS // CHUNKS
_S = [f"s{j}" for j in range(SKETCH // 64)]
_SMALL = ["cls", "n", *_S]


def minima(flat: np.ndarray, first: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Least hash of each set under functions ``lo`` to ``hi``; sets are not empty."""
    out = np.empty((len(first) - 1, hi - lo), np.uint64)
    block = 1 << 16
    sets = np.arange(0)
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + block, "right")) - 1)
        part, sets = flat[first[a] : first[b]], first[a:b] - first[a]
        for k in range(lo, hi):
            x = part ^ _X[k]
            x *= _A[k]
            out[a:b, k - lo] = np.minimum.reduceat(x, sets)
        a = b
    return out


def keys_of(m: np.ndarray) -> np.ndarray:
    """Every chunk with each one symbol left out, as 64-bit keys."""
    symbols = K.mix(m >> np.uint64(32))
    out = []
    for c, left in product(range(CHUNKS), range(_SIDE)):
        h = np.full(len(m), c * _SIDE + left + 1, np.uint64)
        for j in range(_SIDE):
            if j != left:
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += symbols[:, c * _SIDE + j]
        out.append(K.mix(h))
    return np.stack(out, axis=1)


def class_of(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(flat + np.uint64(77)))))
    return K.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _full(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of the texts that have any, their bounds, and which texts those are."""
    flat, first = K.shingles(K.words(text), n)
    has = np.flatnonzero(np.diff(first))
    return flat, np.append(first[:-1][has], first[-1]), has


def _list(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))


def signed(rows: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, cls, keys`` of rows (doc_id, text_hash, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text"):
            flat, first, has = _full(b.column(2), n)
            size, cls = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            keys = np.zeros((b.num_rows, SYMBOLS), np.uint64)
            if len(has):
                size[has], cls[has] = np.diff(first), class_of(flat, first).view(np.int64)
                keys[has] = keys_of(minima(flat, first, 0, SYMBOLS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size), pa.array(cls, mask=size == 0), _list(keys)], ["doc_id", "text_hash", "n_shingles", "cls", "keys"]
            )

    return rows.mapInArrow(sign, f"doc_id {kind}, text_hash long, n_shingles long, cls long, keys array<long>")


def full_sets(rows: DataFrame, n: int) -> DataFrame:
    """``cls, n, shingles, sketch columns`` of rows (text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text"):
            flat, first, has = _full(b.column(0), n)
            if not len(has):
                continue
            bits = (minima(flat, first, SYMBOLS, SYMBOLS + SKETCH) >> np.uint64(40)).astype(np.uint8) & 1
            sketch = np.packbits(bits, axis=1).view(np.int64)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(class_of(flat, first).view(np.int64)), pa.array(np.diff(first)), sets, *[pa.array(sketch[:, j].copy()) for j in range(SKETCH // 64)]],
                ["cls", "n", "shingles", *_S],
            )

    return rows.mapInArrow(make, "cls long, n long, shingles array<long>, " + ", ".join(f"{c} long" for c in _S))


def _differ(x: str, y: str) -> Column:
    """Sketch bits in which both sides differ."""
    return sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in _S), F.lit(0))


def _most(percent: int) -> int:
    """Sketch bits in which sets at the threshold differ, and five standard deviations."""
    p = (1 - percent / 100) / 2
    return int(SKETCH * p + 5 * (SKETCH * p * (1 - p)) ** 0.5) + 1


def _may_link(x: str, y: str, percent: int) -> Column:
    """Set sizes and sketches of both sides allow the threshold."""
    xn, yn = F.col(f"{x}n"), F.col(f"{y}n")
    return (100 * F.least(xn, yn) >= percent * F.greatest(xn, yn)) & (_differ(x, y) <= _most(percent))


def _sides(t: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return t.select(*[F.col(k).alias(f"{side}{k}") for k in columns])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    both = pairs.join(_sides(sets, "y", ["cls", "shingles"]), F.col("b") == F.col("ycls")).join(
        _sides(sets, "x", ["cls", "shingles"]), F.col("a") == F.col("xcls")
    )
    common = F.size(F.array_intersect("xshingles", "yshingles"))
    union = F.size("xshingles") + F.size("yshingles") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sketches of both, as x and y columns."""
    small = sets.select(*_SMALL)
    return pairs.join(_sides(small, "x", _SMALL), F.col("a") == F.col("xcls")).join(_sides(small, "y", _SMALL), F.col("b") == F.col("ycls"))


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """``key, cls, comp`` of the buckets that hold several components."""
    labelled = shared.select("key", "cls").join(comps, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return staged(labelled.join(mixed, "key", "left_semi"))


def _stars(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).where("a != b")


def _alike(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sides of the sketches (one column a word) that differ in at most ``most`` bits."""
    x, y = x.view(np.uint64), y.view(np.uint64)  # of a negative number NumPy counts the bits of its absolute value
    differ = np.zeros((len(x), len(y)), np.uint16)
    for j in range(x.shape[1]):
        differ += np.bitwise_count(x[:, j, None] ^ y[None, :, j])
    return np.nonzero(differ <= most)


def fine_keys(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, key``: the shingles of each set's prefix (of rows cls, n, shingles) that others hold too."""
    held = sets.select("cls", "n", F.explode("shingles").alias("key"))
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("cls")
    placed = held.join(often, "key").withColumn("k", F.row_number().over(own.orderBy("f", "key")))
    placed = placed.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))  # of the set's shingles, those that no other holds come first
    return placed.where(F.col("alone") + F.col("k") <= F.expr(f"n * {100 - percent} div 100") + 1).select("cls", "key")


def _shape(filed: DataFrame) -> DataFrame:
    """``key, main, others, strays, mains``: each bucket's largest component, its other members, and blocks of both; only buckets of several components."""
    weight = F.sum("n") if "shingles" in filed.columns else F.lit(0)
    sizes = filed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), weight.alias("w")).groupBy("key")
    sizes = sizes.agg(F.sum("c").alias("all"), F.sum("w").alias("w"), F.max(F.struct("c", "comp", "w")).alias("top"))
    sizes = sizes.withColumn("others", F.col("all") - F.col("top.c"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / SHINGLES)).cast("int")
    strays, mains = blocks(F.col("others"), F.col("w") - F.col("top.w")), blocks(F.col("top.c"), F.col("top.w"))
    return sizes.where("others > 0").select("key", F.col("top.comp").alias("main"), "others", strays.alias("strays"), mains.alias("mains"))


def _dealt(filed: DataFrame) -> DataFrame:
    """The rows of ``filed``, once for each two blocks (lo, hi) of a bucket that are to be compared, these together.

    The members outside a bucket's largest component are dealt into blocks of about BLOCK
    members, and those inside into others. Each block of the former is compared with each of
    its kind and each of the latter: no task ever holds a bucket, only two blocks of it.
    """
    dealt = filed.join(_shape(filed), "key").withColumn("stray", F.col("comp") != F.col("main"))
    # Blocks of strays are numbered from 0, those of the largest component after them.
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))).cast("int"))
    dealt = dealt.withColumn("own", F.when(F.col("stray"), F.col("own")).otherwise(F.col("own") + F.col("strays")))
    with_ = F.when(F.col("stray"), F.col("strays") + F.col("mains")).otherwise(F.col("strays"))
    dealt = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), with_ - 1)))
    full = [c for c in filed.columns if c == "shingles"]
    dealt = dealt.select("key", F.least("own", "g").alias("lo"), F.greatest("own", "g").alias("hi"), "own", "comp", *_SMALL, *full)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own")


def _alike_in(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Dealt rows, and for each two blocks in them (begin, end, u, v): the places u and v of different components that sizes and sketches allow."""
    most = _most(percent)
    held = None
    for b in chain(batches, [None]):
        parts = [x for x in (held, b) if x is not None and x.num_rows]
        if not parts:
            continue
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        group = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")])
        bounds = np.concatenate(([0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
        if b is not None:
            held = t.slice(int(bounds[-2]))
            bounds = bounds[:-1]
        else:
            held = None
        comp, n, own = (t.column(c).to_numpy() for c in ("comp", "n", "own"))
        sketch = np.stack([t.column(c).to_numpy() for c in _S], axis=1)
        found = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            one_block = group[1, s] == group[2, s]
            cut = e if one_block else s + int(np.searchsorted(own[s:e], group[1, s], "right"))
            xs, ys = (s, cut), (s, e) if one_block else (cut, e)
            if xs[0] == xs[1] or ys[0] == ys[1] or (comp[s:e] == comp[s]).all():
                continue
            u, v = _alike(sketch[slice(*xs)], sketch[slice(*ys)], most)
            u, v = u + xs[0], v + ys[0]
            ok = (comp[u] != comp[v]) & (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v]))
            ok &= (u < v) if one_block else True
            if ok.any():
                found.append((s, e, u[ok], v[ok]))
        if found:
            yield t, found


def _joining(sets: pa.Array, comp: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of places (u ascending, v) whose sets link, only those that join components which no pair before them joins."""
    first = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
    values, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    mark, label = np.zeros(len(values), bool), np.unique(comp, return_inverse=True)[1]
    out = []
    begins = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    for x, ys in zip(u[begins].tolist(), np.split(v, begins[1:]), strict=True):
        ys = ys[label[ys] != label[x]]
        if not len(ys):
            continue
        own = ids[first[x] : first[x + 1]]
        mark[own] = True
        size = first[ys + 1] - first[ys]
        start = np.cumsum(size) - size
        places = np.repeat(first[ys] - start, size) + np.arange(size.sum())
        common = np.add.reduceat(mark[ids[places]], start, dtype=np.int64)
        mark[own] = False
        for y in ys[100 * common >= percent * (len(own) + size - common)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _met(filed: DataFrame, percent: int) -> DataFrame:
    """``key, cls`` of the members that have a partner in their bucket, at most one row for each row dealt."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, found in _alike_in(batches, percent):
            at = np.concatenate([np.unique(np.concatenate((u, v))) for _, _, u, v in found])
            yield t.select(["key", "cls"]).take(pa.array(at))

    return _dealt(filed).mapInArrow(meet, "key long, cls long")


def _within(filed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that sizes and sketches allow.

    Where ``filed`` has the full sets (``shingles``), the pairs that link, and of these only as
    many as join the components of two blocks.
    """
    full = "shingles" in filed.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, found in _alike_in(batches, percent):
            cls = t.column("cls").to_numpy()
            if full:
                sets, comp = t.column("shingles"), t.column("comp").to_numpy()
                at = [(s + x, s + y) for s, e, u, v in found for x, y in _joining(sets.slice(s, e - s), comp[s:e], u - s, v - s, percent)]
                u, v = np.array(at, np.int64).reshape(-1, 2).T
            else:
                u, v = (np.concatenate([x[k] for x in found]) for k in (2, 3))
            a, c = cls[u], cls[v]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return _dealt(filed).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, cls, component_id, kept`` per row.

    Rows link where 100 * intersection >= percent * union of their n-word shingle sets.
    ``component_id`` is the least id reachable; ``kept`` holds where the row has that id.
    """
    small_batches(df.sparkSession)
    rows = texts(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    docs = staged(signed(rows, n))
    classes = docs.where("n_shingles > 0").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    filed = classes.select("cls", "n", F.explode("keys").alias("key"))
    buckets = filed.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least != most").select("key", "least")
    shared = staged(filed.join(buckets, "key"))
    members = shared.select("cls").distinct()
    chosen = docs.join(members, "cls").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    chosen = chosen.select("cls", F.xxhash64("r.doc_id", "r.text_hash").alias("row_key"))
    texts_of = lambda some: rows.withColumn("row_key", F.xxhash64("doc_id", "text_hash")).join(some, "row_key", "left_semi").select("text")
    sets = staged(full_sets(texts_of(chosen), n).dropDuplicates(["cls"]))
    pairs = shared.where("cls != least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    tried = staged(_sketched(pairs, sets).where(_may_link("x", "y", percent)).select("a", "b"))
    links = staged(_confirmed(tried, sets, percent))
    comps = components(links)
    for k in range(PASSES):
        mixed = _mixed(shared, comps)
        leaders = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "cls", F.lit(k)), "cls", "comp")).alias("l"))
        pairs = mixed.join(leaders, "key").where("comp != l.comp")
        pairs = pairs.select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b"), F.col("cls").alias("own")).distinct()
        near = Window.partitionBy("own").orderBy("d", "a", "b")
        pairs = _sketched(pairs, sets).where(_may_link("x", "y", percent)).select("a", "b", "own", _differ("x", "y").alias("d"))
        pairs = pairs.withColumn("k", F.row_number().over(near)).where(F.col("k") <= NEAREST).select("a", "b").distinct()
        more = staged(_confirmed(pairs, sets, percent))
        if more.isEmpty():
            break
        comps = components(_stars(comps).unionByName(more))

    # Exactly: all that share a bucket across the components still apart.
    filed = _mixed(shared, comps)
    crowded = staged(_shape(filed).where(F.col("others") > CROWDED).select("key"))
    if not crowded.isEmpty():
        own = filed.join(crowded, "key", "left_semi").select("cls", "comp").distinct()
        finer = fine_keys(sets.join(own, "cls", "left_semi"), percent).join(own, "cls").select("key", "cls", "comp")
        filed = staged(filed.join(crowded, "key", "left_anti").unionByName(finer))
    filed = staged(filed.join(sets.select(*_SMALL), "cls"))
    filed = staged(filed.join(_met(filed, percent), ["key", "cls"], "left_semi"))
    more = staged(_within(filed.join(sets.select("cls", "shingles"), "cls"), percent))
    if not more.isEmpty():
        comps = components(_stars(comps).unionByName(more))

    labelled = docs.drop("keys").join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node")
    least = labelled.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    found = labelled.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least_id")))
    return found.select("doc_id", "text_hash", "n_shingles", "cls", "comp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` but for all copies: one row of each component stays, the least id's.

    Of equal rows one stays; so does every row without words, which has no copies.
    """
    found = staged(near_duplicates(df, n, percent, id_col, text_col))
    # One row of a component: the least id, then the least text hash.
    best = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    gone = found.join(best, "comp").where(~own.eqNullSafe(F.col("best"))).select("doc_id", "text_hash").distinct()
    gone = gone.select(F.xxhash64("doc_id", "text_hash").alias("gone_key"))
    key = F.xxhash64(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("row_key"))
    kept = packed.join(gone, F.col("row_key") == F.col("gone_key"), "left_anti")
    # Rows that are equal in id and text share a key; only where there are such are rows of one key dealt out.
    twice = found.where("comp is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not twice.isEmpty():
        doubled = twice.select(F.xxhash64("doc_id", "text_hash").alias("gone_key"))
        again = kept.join(doubled, F.col("row_key") == F.col("gone_key"), "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(doubled, F.col("row_key") == F.col("gone_key"), "left_anti").unionByName(again)
    return kept.select("row.*")
