"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text and, with ``wrapped``, also every window of as many words as
the template has, over line ends too, so that statements and whole license texts broken
over lines are found. Blocks and templates are sets of words (runs of letters and digits,
A-Z lower-cased). Every block that holds at least ``threshold`` of a template's words is
found, by these exact filters:

* tokens are ordered globally by the number of lines that have them in the whole table
  (counted first, for template words only), rarest first;
* prefix filter: a block that meets the threshold has one of the template's first
  n - ceil(threshold * n) + 1 tokens. These are an inverted index from token to templates:
  a token's occurrences name the (block, template) pairs that are looked at, and no others;
* length filter: the block has at least ceil(threshold * n) words that occur in templates
  (a window: of that template, repeats counted). Windows begin at words of the template, as
  the first word of others adds nothing;
* positional filter: walking a template's tokens in that order, a block is given up as
  soon as those seen and all that remain can't reach the threshold.

Licenses of one family differ in a word or two, fewer than the threshold forgives. So a
block that meets a template must also hold the words that are its own (a version's number,
``sa``, ``mit``) and none that is another's, see :mod:`license_texts`.

Windows that meet a template and overlap are one statement; the best is reported, the
first of equals, and none that touches a line found for that template.

Beside the templates, fixed phrases are located word by word. Templates are a small
stated set (``TEMPLATES``), so they travel with the function.

Null and empty texts have no words and no labels. Rows are scanned one by one; repeated
rows and ids keep their rows. Of the input only the id and the text are read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .license_texts import PHRASES, TEMPLATES, Template
from .shared import small_batches, texts

THRESHOLD = 0.8


def word_set(text: str) -> np.ndarray:
    return np.unique(K.words(pa.array([text]), K.ALNUM).hashes)


def vocabulary_of(templates: tuple[Template, ...]) -> np.ndarray:
    """Every word that decides about a block."""
    sets = [word_set(x) for t in templates for x in (t.text, t.must, t.never)]
    return np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)


class Scanner:
    """Templates with their tokens in global order, rarest first, indexed by prefix token."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[int, int], threshold: float):
        self.labels = [t.label for t in templates]
        self.vocabulary = vocabulary_of(templates)
        rank = sorted(self.vocabulary.tolist(), key=lambda h: (counts.get(h, 0), h))
        order = {h: r for r, h in enumerate(rank)}
        self.rank_of = np.array([order[h] for h in self.vocabulary.tolist()], np.int64)
        ranks = lambda text: sorted(order[h] for h in word_set(text).tolist())
        self.tokens = [ranks(t.text) for t in templates]
        self.must, self.never = [set(ranks(t.must)) for t in templates], [set(ranks(t.never)) for t in templates]
        self.sizes = [len(K.words(pa.array([t.text]), K.ALNUM).hashes) for t in templates]
        self.need = [max(1, ceil(threshold * len(t) - 1e-9)) for t in self.tokens]
        self.phrases = [(K.words(pa.array([p]), K.ALNUM).hashes, label) for p, label in PHRASES]
        # Token -> templates in whose prefix it is, end to end with each token's first place.
        posted = sorted((x, t) for t, (tokens, need) in enumerate(zip(self.tokens, self.need, strict=True)) for x in tokens[: len(tokens) - need + 1])
        self.posting = np.array([t for _, t in posted], np.int64)
        self.first = np.searchsorted(np.array([x for x, _ in posted], np.int64), np.arange(len(rank) + 1))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the global order, -1 for words of no template."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocabulary):
            k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            ok = self.vocabulary[k] == h
            out[ok] = self.rank_of[k[ok]]
        return out

    def pairs(self, rank: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
        """(group, template) wherever a word of the group (a line, a text) is in the template's prefix; by group."""
        at = np.flatnonzero(rank >= 0)
        lo, hi = self.first[rank[at]], self.first[rank[at] + 1]
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        owner = np.repeat(np.arange(len(at)), hi - lo)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[owner]
        if not len(owner):
            return []
        n = len(self.labels)
        both = np.unique(group[at[owner]] * n + self.posting[place])
        return list(zip((both // n).tolist(), (both % n).tolist(), strict=True))

    def blocks(self, rank: np.ndarray, block: np.ndarray) -> list[tuple[int, int, float]]:
        """(block, template, containment) of all that meet the threshold; ``block`` ascends."""
        out, now, own = [], -1, set()
        for b, t in self.pairs(rank, block):
            if b != now:
                lo, hi = np.searchsorted(block, [b, b + 1])
                now, own = b, set(rank[lo:hi][rank[lo:hi] >= 0].tolist())
            if share := self._share(own, t):
                out.append((b, t, share))
        return out

    def _share(self, own: set[int], t: int) -> float:
        """The containment of template ``t`` in a block's words, 0 where it doesn't match."""
        tokens, seen = self.tokens[t], 0
        if len(own) < self.need[t] or not self.must[t] <= own or self.never[t] & own:
            return 0.0
        for p, x in enumerate(tokens):
            seen += x in own
            if seen + len(tokens) - p - 1 < self.need[t]:
                return 0.0
        return seen / len(tokens)

    def windows(self, rank: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, words, template, containment): the best of each run of overlapping windows."""
        out = []
        known = np.flatnonzero(rank >= 0)
        r, of_text = rank[known], text[known]
        for d, t in self.pairs(rank, text):
            lo, hi = np.searchsorted(of_text, [d, d + 1])
            end_of_text = int(np.searchsorted(text, d, "right"))
            out += self._best(r[lo:hi], known[lo:hi], end_of_text, t)
        return sorted(out)

    def _best(self, ranks: np.ndarray, places: np.ndarray, end_of_text: int, t: int) -> Iterator[tuple[int, int, int, float]]:
        tokens, need, n = self.tokens[t], self.need[t], self.sizes[t]
        own = np.isin(ranks, tokens)
        at, words = places[own], ranks[own]
        end = np.minimum(at + n, end_of_text)
        until, begin = np.searchsorted(at, end), np.arange(len(at))
        opened = np.concatenate(([0], np.cumsum(np.isin(words, tokens[: len(tokens) - need + 1]))))
        barred = places[np.isin(ranks, list(self.never[t]))]
        ok = (until - begin >= need) & (opened[until] > opened[begin]) & (np.searchsorted(barred, at) == np.searchsorted(barred, end))
        best, last = None, -1
        for i in np.flatnonzero(ok).tolist():
            share = self._share(set(words[i : until[i]].tolist()), t)
            if not share:
                continue
            if best and at[i] < last:
                best = max(best, (share, -i))
            else:
                if best:
                    yield int(at[-best[1]]), int(end[-best[1]] - at[-best[1]]), t, best[0]
                best = (share, -i)
            last = end[i]
        if best:
            yield int(at[-best[1]]), int(end[-best[1]] - at[-best[1]]), t, best[0]

    def places(self, w: K.Words) -> list[tuple[np.ndarray, str]]:
        """First words of every phrase's occurrences, within one text."""
        out = []
        text = w.text_of()
        for h, label in self.phrases:
            at = np.flatnonzero(w.hashes == h[0])
            for j in range(1, len(h)):
                at = at[at + j < len(w.hashes)]
                at = at[(w.hashes[at + j] == h[j]) & (text[at + j] == text[at])]
            out.append((at, label))
        return out


def line_of(text: pa.Array, starts: np.ndarray) -> np.ndarray:
    """The block of each word: lines are counted through all texts, and a text starts a new one."""
    data, offsets = K.buffers(text)
    ends = np.flatnonzero(data == 10)
    return np.searchsorted(ends, starts) + np.searchsorted(offsets[1:], starts, "right")


def block_counts(rows: DataFrame, templates: tuple[Template, ...]) -> dict[int, int]:
    """In how many blocks of the whole table each template word occurs. Only template words are sent."""
    known = vocabulary_of(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in K.blocks(batches, "text"):
            w = K.words(b.column(0), K.ALNUM)
            k = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1) if len(known) else np.zeros(0, np.int64)
            at = np.flatnonzero(known[k] == w.hashes) if len(known) else k
            line = line_of(b.column(0), w.starts[at])
            pair = np.unique(line * len(known) + k[at])
            total += np.bincount(pair % max(1, len(known)), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["h", "n"])

    got = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in got}


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``blocks`` lists what was found: label, containment, and the block's first word and
    length in words. ``score`` is the greatest containment, 1 where a phrase stands.
    ``wrapped`` also finds statements that go over line ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = texts(df, id_col, text_col)
    scanner = Scanner(templates, block_counts(rows, templates), threshold)
    kind = rows.schema["doc_id"].dataType.simpleString()
    block = pa.struct([("label", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text"):
            w = K.words(b.column(1), K.ALNUM)
            text, n = w.text_of(), b.num_rows
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for at, label in scanner.places(w):
                for p in at.tolist():
                    t = int(text[p])
                    base[t].append((p - int(w.first[t]), label))
            found: list[list[dict]] = [[] for _ in range(n)]
            line = line_of(b.column(1), w.starts)
            rank = scanner.ranks(w.hashes)
            spans = []
            for g, t, share in scanner.blocks(rank, line):
                lo, hi = np.searchsorted(line, [g, g + 1])
                spans.append((int(lo), int(hi - lo), t, share))
            if wrapped:
                lines = {(int(line[p]), t) for p, _, t, _ in spans}
                for p, size, t, share in scanner.windows(rank, text):
                    if not any((x, t) in lines for x in range(int(line[p]), int(line[p + size - 1]) + 1)):
                        spans.append((p, size, t, share))
            for lo, size, t, share in sorted(spans):
                d = int(text[lo])
                found[d].append({"label": scanner.labels[t], "containment": share, "first_word": lo - int(w.first[d]), "n_words": size})
            own = [",".join(sorted({x for _, x in p})) for p in base]
            every = [",".join(sorted({x for _, x in p} | {x["label"] for x in f})) for p, f in zip(base, found, strict=True)]
            score = [1.0 if p else max((x["containment"] for x in f), default=0.0) for p, f in zip(base, found, strict=True)]
            first = [min(x for x, _ in p) if p else None for p in base]
            last = [max(x for x, _ in p) if p else None for p in base]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(w.counts()), pa.array([len(p) for p in base], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                    pa.array(own, pa.string()), pa.array(every, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(block)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    return rows.mapInArrow(
        scanned,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<label: string, containment: double, first_word: long, n_words: long>>",
    )
