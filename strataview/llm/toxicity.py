"""Toxicity: gradient-boosted trees over dense text features, isotonically calibrated.

Features of a whole text: densities of a learned lexicon (whole words and word stems, in
three strengths), its hits next to second-person words, capitals, punctuation and
obfuscation rates (digits and symbols inside words; lexicon words that appear only once
those are read as letters). The lexicon, the trees and the calibration are fitted on at
most ``max_train`` labelled rows, drawn by class and a hash of the id: up to half of them
of each class, more where the other class has fewer. Scores are put back to the odds that
the classes have among all labels. Each half of the rows (each class dealt in turn) is
scored with the other half's lexicon, so the trees see honest lexicon features. Likewise
the calibration is fitted on the margins that each half gets from trees of the other one,
and then serves the trees of all rows. A lexicon holds the ``LEXICON`` strongest units
(a parameter of the model); they are ranked and cut on the executors. Where a
half lacks a class (a single toxic or clean label), both share one lexicon, and the trees'
own probability stands without calibration. Scoring reads every text once, in NumPy over
Arrow buffers, and needs no shuffle.

Null and empty texts get the score of a text without words. Rows are scored one by one,
so repeated rows and ids keep their rows. Labels that are null, or whose id is no
document's, are not used; an id's label is the greatest of its labels, and one row of an
id (of the least text hash) is fitted on, so no id brings more rows than it has labels.
With no usable labels (or only one class) the score is the labels' mean, 0 without any.
Of the input only the id and the text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, staged, texts

MAX_TRAIN = 8000
LEXICON = 3000
CUTS = (4, 5, 6, 7)
NEAR = 5
BLOCK = 1 << 20  # bytes of text whose features are made at once

#: Second-person words, lower case, of the four languages.
YOU = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos "
    "du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros"
).split()
#: Characters read as letters when obfuscation is undone.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LEET_WORD = K.ALNUM.copy()
_LEET_VALUE = K.LOWER.copy()
for _c, _l in LEET.items():
    _LEET_WORD[ord(_c)] = 1
    _LEET_VALUE[ord(_c)] = K.LOWER[ord(_l)]
_UPPER = np.zeros(256, np.uint8)
_UPPER[0x41:0x5B] = 1
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = 1
_LETTER[0x80:] = 1
_BANG = np.zeros(256, np.uint8)
_BANG[[0x21, 0x3F]] = 1
_PUNCT = np.zeros(256, np.uint8)
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = 1
_ODD = np.zeros(256, np.uint8)
_ODD[[ord(c) for c in "0123456789@$*!"]] = 1


def units(w: K.Words, data: np.ndarray, values: np.ndarray = K.LOWER) -> list[np.ndarray]:
    """Per word: the hash of the word and of its first 4 to 7 bytes, 0 where it is no longer."""
    whole, *heads = K.span_hashes(data, w.starts, w.ends, values, CUTS)
    size = w.ends - w.starts
    return [whole, *[np.where(size > k, h ^ np.uint64(k), np.uint64(0)) for k, h in zip(CUTS, heads, strict=True)]]


@dataclass
class Lexicon:
    """Sorted unit hashes with their log-odds, and a bit table that rejects most others."""

    keys: np.ndarray
    odds: np.ndarray

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hits in ``h`` and their log-odds."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(self.table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], self.odds[k[ok]]


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


_you = np.sort(np.array([K.seeded(x) for x in YOU], np.uint64))
N_FEATURES = 22


def _word_odds(us: list[np.ndarray], lexicon: Lexicon) -> np.ndarray:
    best = np.zeros(len(us[0]))
    for u in us:
        at, odds = lexicon.find(u)
        best[at] = np.maximum(best[at], odds)
    return best


def features(text: pa.Array, lexicons: list[Lexicon]) -> list[np.ndarray]:
    """For each lexicon, the features of every text."""
    data, offsets = K.buffers(text)
    starts, ends = K.word_spans(data, offsets, K.ALNUM)
    w = K.Words(np.zeros(0, np.uint64), starts, ends, np.searchsorted(starts, offsets))
    us = units(w, data)
    ls, le = K.word_spans(data, offsets, _LEET_WORD)
    odd = np.concatenate(([0], np.cumsum(_ODD[data])))
    mixed = odd[le] > odd[ls]
    ls, le = ls[mixed], le[mixed]
    lw = K.Words(np.zeros(0, np.uint64), ls, le, np.searchsorted(ls, offsets))
    lu = units(lw, data, _LEET_VALUE)
    n, size = np.maximum(w.counts(), 1).astype(float), np.maximum(np.diff(offsets), 1).astype(float)
    doc, ldoc = w.text_of(), lw.text_of()
    k = np.minimum(np.searchsorted(_you, us[0]), len(_you) - 1)
    you = np.flatnonzero(_you[k] == us[0])
    caps = _sums(_UPPER[data], offsets)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = ((upper[ends] - upper[starts]) == ends - starts) & (ends - starts > 1)
    count = lambda d, v=None: np.bincount(d, v, minlength=len(text))[: len(text)].astype(float)
    letters = _sums(_LETTER[data], offsets)
    inner = np.zeros(len(data), np.uint8)
    if len(data) > 2:
        inner[1:-1] = _ODD[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
        full = np.flatnonzero(np.diff(offsets))
        inner[offsets[full]] = inner[offsets[full + 1] - 1] = 0  # neighbours are in the same text
    common = [
        np.log1p(w.counts()),
        count(doc[shouted]) / n,
        caps / np.maximum(letters, 1),
        _sums(_BANG[data], offsets) / size,
        _sums(_PUNCT[data], offsets) / size,
        _sums(inner, offsets) / n,
        count(doc[you]) / n,
    ]
    out = []
    for lex in lexicons:
        odds = _word_odds(us, lex)
        hit = np.flatnonzero(odds)
        v, d = odds[hit], doc[hit]
        parts = []
        for lo, hi in ((0.0, 2.0), (2.0, 3.5), (3.5, 99.0)):
            m = (v > lo) & (v <= hi)
            c = count(d[m])
            parts += [c, c / n]
        strongest = np.zeros(len(text))
        np.maximum.at(strongest, d, v)
        top2 = count(d, v)
        near = np.zeros(len(hit))
        if len(you) and len(hit):
            p = np.searchsorted(you, hit)
            for q in (np.minimum(p, len(you) - 1), np.maximum(p - 1, 0)):
                near = np.maximum(near, (np.abs(you[q] - hit) <= NEAR) & (doc[you[q]] == d) & (v > 2))
        lo = _word_odds(lu, lex) if len(lu[0]) else np.zeros(0)
        hidden = count(ldoc[lo > 2])
        distinct = np.zeros(len(text))
        if len(hit):
            strong = v > 2
            pair = np.unique(np.stack([d[strong].astype(np.uint64), us[0][hit][strong]]), axis=1)
            distinct = count(pair[0].astype(np.int64))
        parts += [strongest, top2, top2 / n, np.sqrt(top2 / n), distinct, count(d, near), count(d, near) / n, hidden, hidden / n]
        out.append(np.stack([*common, *parts], axis=1))
    return out


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 48, least: int = 12, ridge: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, node = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full tree by levels: node i has children 2i+1 and 2i+2; no gain sends all rows left."""
        size = 2 ** (self.depth + 1) - 1
        col, cut, value = np.zeros(size, np.int64), np.full(size, 1 << 30), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for i in range(2**self.depth - 1):
            rows = np.flatnonzero(node == i)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = 1e-3
            for j in range(b.shape[1]) if len(rows) >= 2 * self.least else ():
                v = b[rows, j]
                m = len(self.edges[j]) + 1
                gl = np.cumsum(np.bincount(v, g[rows], m))[:-1]
                hl = np.cumsum(np.bincount(v, h[rows], m))[:-1]
                nl = np.cumsum(np.bincount(v, minlength=m))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                if len(gain) and gain.max() > best:
                    best, col[i], cut[i] = float(gain.max()), j, int(gain.argmax())
            right = b[rows, col[i]] > cut[i]
            node[rows] = 2 * i + 1 + right
        for i in range(2**self.depth - 1, size):
            rows = node == i
            value[i] = self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
        return (col, cut, value), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for col, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, col[node]] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of ``y`` on ``x`` (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, s = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, p[2] + s]
    return np.array([s / n for _, n, s in blocks]), np.array([m for m, _, _ in blocks])


def at_odds(p: np.ndarray, ratio: float) -> np.ndarray:
    """Probabilities with their odds multiplied by ``ratio``."""
    return p * ratio / (p * ratio + 1 - p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float
    ratio: float = 1.0  # odds of toxic among all labels, to those among the rows fitted on

    def score(self, text: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(text), self.prior)
        m = self.trees.margin(features(text, [self.lexicon])[0])
        return at_odds(np.interp(m, *self.knots) if self.knots else 1 / (1 + np.exp(-m)), self.ratio)


def _lexicon(counted: DataFrame, tox: Column, all_: Column, n_tox: float, n_all: float, least: int) -> Lexicon:
    """Units that mark toxic texts: smoothed log-odds of document frequency, strongest first.

    Ranked on the executors; LEXICON rows at most come to the driver.
    """
    odds = F.ln((tox + 0.5) / (n_tox + 1)) - F.ln((all_ - tox + 0.5) / (n_all - n_tox + 1))
    strongest = (
        counted.select("u", odds.alias("odds"), tox.alias("t")).where((F.col("t") >= least) & (F.col("odds") > 1.0))
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "u").limit(LEXICON).toPandas()
    )
    keys = strongest["u"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], strongest["odds"].to_numpy(float)[order])


def _least(toxic: float, most: int) -> int:
    """How many toxic texts must have a unit: ``most``, fewer where there are few toxic texts."""
    return int(max(min(2, toxic), min(most, toxic // 3)))


def _trees(y: np.ndarray) -> Trees:
    """Trees whose leaves are small enough for the smaller class."""
    return Trees(least=int(max(1, min(12, min(y.sum(), len(y) - y.sum()) // 2))))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` rows of ``labels``; the caller leaves out what is held out."""
    spark = df.sparkSession
    small_batches(spark)
    labelled = staged(
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("label_id").agg(F.max("y").alias("y"))
    )
    of = {r["toxic"]: r["n"] for r in labelled.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = of.get(True, 0), of.get(False, 0)
    n_toxic = min(toxic, max(max_train // 2, max_train - clean))
    n_clean = min(clean, max_train - n_toxic)
    ratio = (toxic / n_toxic) / (clean / n_clean) if n_toxic and n_clean else 1.0
    order = (F.xxhash64("label_id"), F.col("label_id"))
    # The window numbers at most max_train rows.
    chosen = (
        labelled.where("y > 0").orderBy(*order).limit(n_toxic)
        .unionByName(labelled.where("y <= 0").orderBy(*order).limit(n_clean))
        .withColumn("half", F.row_number().over(Window.partitionBy(F.col("y") > 0).orderBy(*order)) % 2 == 0)
    )
    # At most max_train rows are broadcast, and of each id one row is left after the join.
    joined = texts(df, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    one = joined.groupBy("label_id", "y", "half").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    train = staged(one.select("y", "row.text", "half"))

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text", BLOCK):
            data, offsets = K.buffers(b.column(1))
            starts, ends = K.word_spans(data, offsets, K.ALNUM)
            w = K.Words(np.zeros(0, np.uint64), starts, ends, np.searchsorted(starts, offsets))
            doc = w.text_of()
            all_units = np.concatenate(units(w, data))
            docs = np.tile(doc, 1 + len(CUTS))
            ok = all_units != 0
            order = np.lexsort((docs[ok], all_units[ok]))
            u, d = all_units[ok][order], docs[ok][order]
            if not len(u):
                continue
            first = np.ones(len(u), bool)
            first[1:] = (u[1:] != u[:-1]) | (d[1:] != d[:-1])
            u, d = u[first], d[first]
            y = b.column(0).to_numpy(zero_copy_only=False)[d].astype(np.int64)
            half = b.column(2).to_numpy(zero_copy_only=False)[d].astype(np.int64)
            h, at = np.unique(u, return_index=True)
            add = lambda v: np.add.reduceat(v, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), *[pa.array(add(v)) for v in (y * half, half, y * (1 - half), 1 - half)]], ["u", "ta", "na", "tb", "nb"]
            )

    n = train.groupBy("half").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    t = {r["half"]: (float(r["t"]), float(r["n"])) for r in n}
    (ta, na), (tb, nb) = t.get(True, (0.0, 0.0)), t.get(False, (0.0, 0.0))
    prior = (ta + tb) / (na + nb) if na + nb else 0.0
    if not 0 < ta + tb < na + nb:
        empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
        return Model(empty, None, None, prior)
    crossed = min(ta, tb, na - ta, nb - tb) > 0
    least = _least(ta + tb, 4)
    units_of = train.mapInArrow(count_units, "u long, ta long, na long, tb long, nb long")
    counted = staged(units_of.groupBy("u").agg(*[F.sum(c).alias(c) for c in ("ta", "na", "tb", "nb")]).where((F.col("ta") + F.col("tb")) >= least))
    c = F.col
    lexicons = [
        _lexicon(counted, c("ta"), c("na"), ta, na, _least(ta, 3)),
        _lexicon(counted, c("tb"), c("nb"), tb, nb, _least(tb, 3)),
        _lexicon(counted, c("ta") + c("tb"), c("na") + c("nb"), ta + tb, na + nb, least),
    ]
    if not crossed:
        lexicons[:2] = lexicons[2:] * 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text", BLOCK):
            fa, fb = features(b.column(1), lexicons[:2])
            half = b.column(2).to_numpy(zero_copy_only=False)
            x = np.where(half[:, None], fb, fa)  # each half by the other half's lexicon
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x))], ["y", "half", "x"])

    m = train.mapInArrow(measure, "y int, half boolean, x array<double>").toPandas()
    x, y, half = np.array(m["x"].tolist()), m["y"].to_numpy(float), m["half"].to_numpy(bool)
    if not crossed:
        return Model(lexicons[2], _trees(y).fit(x, y), None, prior, ratio)
    margins = np.zeros(len(y))
    for side in (True, False):
        margins[half == side] = _trees(y[half != side]).fit(x[half != side], y[half != side]).margin(x[half == side])
    return Model(lexicons[2], _trees(y).fit(x, y), isotonic(margins, y), prior, ratio)


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, as a column that leaves all others as they are."""

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            rb = pa.RecordBatch.from_arrays([a], ["text"])
            yield pa.array(np.concatenate([model.score(p.column(0)) for p in K.blocks(iter([rb]), "text", BLOCK)] or [np.zeros(0)]))

    return score(F.coalesce(text, F.lit("")))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row."""
    small_batches(df.sparkSession)
    return texts(df, id_col, text_col).select("doc_id", score_column(model, F.col("text")).alias("score"))
