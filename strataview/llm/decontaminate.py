"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A benchmark item of n words matches a document where some span of its words is within
``max_edits`` (a share of n, rounded down to k) word edits of it. Words are runs of
letters and digits, A-Z lower-cased, other ASCII signs ignored.

Windows of item size are embedded by the CGK random walk, which maps edit distance to
Hamming distance: ``walks(n)`` walks, from each of which ``SAMPLES`` times ``BITS`` sampled
places make one key. Windows and items that share a key are candidates, unless fewer than
n - k words of the item stand about the window; a candidate is verified by exact edit
distance of the item to any span there, both its ends free. Equal windows always share keys; with k edits in the worst mix recall is above 0.95
at every length (longer items take more walks), see the tests.

Which windows are embedded: of k + 1 runs of n // (k + 1) words cut from an item, an edited
copy holds one unchanged. Such runs are looked up at every place of a text (one sorted
array of distinct (run, item size, place in the item); its size grows with the benchmark's
words alone), and a hit names a window start, give or take k words. A start stays if its
neighbourhood has n - k words of the benchmark's vocabulary. Neither step loses a match,
and none compares a window with items; that is left to the keys.

The benchmark is a stated query set. Executors write it in parts of ``BLOCK`` distinct
items into the shared folder, and every Python worker maps the parts: nothing of it passes
through the driver but their names, and all parts are searched in one pass over the
documents. Equal items are searched once and each reported. Items with fewer than
``min_words`` words match where their words stand in a document one after the other,
without edits; an item without words matches nothing.

Of an item's matches in a text the one with the fewest edits is reported, of several the
one that ends first, and of its spans the shortest. Null and empty texts match nothing.
Rows are searched one by one; repeated rows and ids keep their rows. Extra columns of
either table are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import map_file, shared_folder, small_batches, texts, write_file

MAX_EDITS, MIN_WORDS = 0.2, 8
SAMPLES, BITS = 12, 3
BLOCK = 20_000
HITS = 1 << 18
U64 = np.uint64


def walks(n: int) -> int:
    """Walks for items of ``n`` words: edits drive longer walks further apart."""
    return 8 + n // 20


@lru_cache(256)
def _steps(r: int, size: int) -> np.ndarray:
    return np.random.default_rng([5, r]).integers(1, 1 << 62, size, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(256)
def _places(r: int, n: int) -> np.ndarray:
    """SAMPLES times BITS places of a walk. It moves on half the time; a last fifth of the words may be beyond the match."""
    live = max(1, 8 * n // 5)
    rng = np.random.default_rng([n, r])
    return np.stack([rng.choice(live, min(BITS, live), replace=False) for _ in range(SAMPLES)])


def embed(w: np.ndarray, r: int) -> np.ndarray:
    """CGK walk number ``r`` over rows of word hashes: 3n symbols, zero past the end."""
    m, n = w.shape
    padded = np.concatenate([w, np.zeros((m, 1), U64)], axis=1).ravel()
    mixed = padded ^ (padded >> U64(31))
    at, end = np.arange(m) * (n + 1), np.arange(m) * (n + 1) + n
    out = np.empty((3 * n, m), U64)
    for j, step in enumerate(_steps(r, 3 * n)):
        padded.take(at, out=out[j])
        at += ((mixed.take(at) * step) >> U64(63)).view(np.int64)
        np.minimum(at, end, out=at)
    return out


def keys(w: np.ndarray) -> np.ndarray:
    """walks(n) * SAMPLES keys of every row: hashes of sampled places of its embeddings."""
    n = w.shape[1]
    out = np.empty((walks(n) * SAMPLES, len(w)), U64)
    for r in range(walks(n)):
        e = embed(w, r)
        for s, places in enumerate(_places(r, n)):
            h = np.full(len(w), r * SAMPLES + s + 1, U64)
            for p in places:
                h *= U64(0x9E3779B97F4A7C15)
                h += e[p]
            out[r * SAMPLES + s] = K.mix(h)
    return out.T


def _last_row(a: np.ndarray, b: np.ndarray, most: int, free: bool) -> np.ndarray | None:
    """Edits from ``a`` to each prefix of ``b`` (``free``: to the best span that ends there); None where all exceed ``most``."""
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if free else steps
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the row
        if row.min() > most:
            return None
    return row


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two sequences, or ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = _last_row(a, b, most, False)
    return most + 1 if row is None else int(min(row[-1], most + 1))


def best_span(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, first word, words) of the span of ``text`` nearest to ``item``, if within ``most`` edits."""
    row = _last_row(item, text, most, True)
    if row is None or row.min() > most:
        return None
    edits, end = int(row.min()), int(row.argmin())
    back = _last_row(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], most, False)
    size = int(back.argmin())
    return edits, end - size, size


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges end to end, and the range of each."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


def _bits(values: np.ndarray) -> np.ndarray:
    """A table that tells most values that are not among ``values``: about 1 in 32 of others passes."""
    size = 1 << max(10, int(len(values)).bit_length() + 5)
    table = np.zeros(size, np.uint8)
    table[(values & U64(size - 1)).astype(np.int64)] = 1
    return table


def _maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table.take((h & U64(len(table) - 1)).view(np.int64))


def index(ids: pa.Array, text: pa.Array, max_edits: float, min_words: int) -> dict[str, np.ndarray]:
    """The arrays of one part of the benchmark."""
    w = K.words(text, K.ALNUM)
    found: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            found.setdefault(w.hashes[a:b].tobytes(), []).append(i)
    items = [np.frombuffer(x, U64) for x in found]
    size = np.array([len(x) for x in items], np.int64)
    own = np.array([len(x) for x in found.values()], np.int64)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids.take(pa.array([i for x in found.values() for i in x], pa.int64()))], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    most = (max_edits * size).astype(np.int64)
    arrays = {
        "words": np.concatenate(items) if items else np.zeros(0, U64), "first": np.concatenate(([0], np.cumsum(size))), "most": most,
        "ids": np.frombuffer(sink.getvalue(), np.uint8), "own": np.concatenate(([0], np.cumsum(own))),
    }
    seeds: dict[int, list[np.ndarray]] = {}
    edited = np.zeros(0, U64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        stack = np.stack([items[i] for i in rows])
        if n < min_words:
            k = np.array([K.runs(x, n)[0] for x in stack], U64)
            order = np.argsort(k, kind="stable")
            arrays |= {f"short{n}": k[order], f"short{n}_item": rows[order], f"short{n}_bits": _bits(k)}
            continue
        edited = np.unique(np.concatenate([edited, stack.ravel()]))
        k = keys(stack).ravel()
        order = np.argsort(k, kind="stable")
        arrays |= {f"key{n}": k[order], f"key{n}_item": np.repeat(rows, walks(n) * SAMPLES)[order].astype(np.int32)}
        parts = int(most[rows[0]]) + 1
        run = n // parts
        runs = np.lib.stride_tricks.sliding_window_view(stack, run, axis=1)[:, : parts * run : run]
        flat = np.ascontiguousarray(runs).reshape(-1, run)
        h = np.zeros(len(flat), U64)
        for j in range(run):
            h = h * U64(0x9E3779B97F4A7C15) + flat[:, j]
        place = np.tile(np.arange(parts) * run, len(rows))
        seeds.setdefault(run, []).append(np.stack([K.mix(h), np.full(len(h), n, U64), place.astype(U64)]))
    for run, parts in seeds.items():
        s = np.unique(np.concatenate(parts, axis=1), axis=1)  # by run, then size and place
        arrays |= {f"seed{run}": s[0].copy(), f"seed{run}_at": s[1:].astype(np.int64), f"seed{run}_bits": _bits(s[0])}
    return arrays | {"vocabulary_bits": _bits(edited)}


class Part:
    """One part of the benchmark, mapped."""

    def __init__(self, arrays: dict[str, np.ndarray], max_edits: float):
        self.a, self.max_edits = arrays, max_edits
        self.ids = pa.ipc.open_stream(pa.py_buffer(arrays["ids"])).read_all().column(0)
        sizes = lambda name: sorted(int(k[len(name) :]) for k in arrays if k.startswith(name) and k[len(name) :].isdigit())
        self.short, self.seeds = sizes("short"), sizes("seed")

    def item(self, i: int) -> np.ndarray:
        return self.a["words"][self.a["first"][i] : self.a["first"][i + 1]]

    def search(self, w: K.Words, text_of: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits): the best span of each distinct item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self._exact(best, w, text_of)
        pairs = [self._candidates(w, n, s) for n, s in self._starts(w, text_of)]
        if pairs:
            start, item = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((start, item, text_of[start]))
            if len(order):
                self._verify(best, w, text_of, start[order], item[order])
        return sorted((t, i, p, n, d) for (t, i), (d, p, n) in best.items())

    def _exact(self, best: dict, w: K.Words, text_of: np.ndarray) -> None:
        """The first place of every short item in every text, word for word."""
        for n in self.short:
            item_keys, owner = self.a[f"short{n}"], self.a[f"short{n}_item"]
            run = K.runs(w.hashes, n)
            at = np.flatnonzero(_maybe(self.a[f"short{n}_bits"], run))
            at = at[text_of[at] == text_of[at + n - 1]]
            left, right = np.searchsorted(item_keys, run[at]), np.searchsorted(item_keys, run[at], "right")
            hit = right > left
            if not hit.any():
                continue
            # Of a text's equal runs the first is enough.
            at, left, right = at[hit], left[hit], right[hit]
            _, one = np.unique(np.stack([text_of[at], left]), axis=1, return_index=True)
            for p, a, z in zip(at[one].tolist(), left[one].tolist(), right[one].tolist(), strict=True):
                for i in owner[a:z].tolist():
                    t = int(text_of[p])
                    if (w.hashes[p : p + n] == self.item(i)).all():
                        best[t, i] = (0, p - int(w.first[t]), n)

    def _starts(self, w: K.Words, text_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Item sizes with the starts of windows that an unchanged run of an item names."""
        known = np.concatenate(([0], np.cumsum(_maybe(self.a["vocabulary_bits"], w.hashes), dtype=np.int64)))
        found = []
        for run in self.seeds:
            key, at = self.a[f"seed{run}"], self.a[f"seed{run}_at"]
            h = K.runs(w.hashes, run)
            p = np.flatnonzero(_maybe(self.a[f"seed{run}_bits"], h))
            p = p[text_of[p] == text_of[p + run - 1]]
            lo, hi = np.searchsorted(key, h[p]), np.searchsorted(key, h[p], "right")
            p, lo, hi = (x[hi > lo] for x in (p, lo, hi))
            total, a = np.cumsum(hi - lo), 0
            while a < len(p):
                # About HITS at once, however many sizes and places a frequent run stands for.
                z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
                j, owner = _ragged(lo[a:z], hi[a:z])
                n, place = at[0][j], at[1][j]
                p_, a = p[a:z][owner], z
                t = text_of[p_]
                begin, end = w.first[t], w.first[t + 1]
                most = (self.max_edits * n).astype(np.int64)
                first, last = np.maximum(p_ - place - most, begin), np.minimum(p_ - place + n + most, end)
                ok = known[last] - known[first] >= n - most
                if ok.any():
                    found.append(np.unique(np.stack([n[ok], p_[ok] - place[ok], begin[ok], end[ok]]), axis=1))
        if not found:
            return
        n, start, begin, end = np.unique(np.concatenate(found, axis=1), axis=1)
        for size in np.unique(n).tolist():
            m = n == size
            most = int(self.max_edits * size)
            near = start[m][:, None] + np.arange(-most, most + 1)
            # Starts before the text, or where less than a match is left, are moved to the nearest that can be one.
            last = np.maximum(end[m] - (size - most), begin[m])
            yield size, np.unique(np.clip(near, begin[m][:, None], last[:, None]))

    def _candidates(self, w: K.Words, n: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of ``n`` words (zeros past a text's end) and items that share a key.

        Equal windows are looked up once. A pair is left out where fewer than n - most of the
        item's words stand about the window, as then no span there can match.
        """
        item_keys, owner = self.a[f"key{n}"], self.a[f"key{n}_item"]
        place = np.searchsorted(w.first, start, "right")
        begin, end = w.first[place - 1], w.first[place]
        most = int(self.max_edits * n)
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(start), 1 << 12):
            s = start[lo : lo + (1 << 12)]
            at = s[:, None] + np.arange(n)
            inside = at < end[lo : lo + (1 << 12), None]
            windows = np.where(inside, w.hashes[np.where(inside, at, 0)], U64(0))
            h = np.zeros(len(s), U64)
            for j in range(n):
                h = h * U64(0x9E3779B97F4A7C15) + windows[:, j]
            _, one, same = np.unique(h, return_index=True, return_inverse=True)
            k = keys(windows[one])
            left, right = np.searchsorted(item_keys, k), np.searchsorted(item_keys, k, "right")
            members = np.argsort(same, kind="stable")
            bounds = np.searchsorted(same[members], np.arange(len(one) + 1))
            for r in np.flatnonzero((right > left).any(axis=1)).tolist():
                found = np.unique(owner[_ragged(left[r], right[r])[0]]).astype(np.int64)
                words = self.a["words"][self.a["first"][found][:, None] + np.arange(n)]
                for p in (members[bounds[r] : bounds[r + 1]] + lo).tolist():
                    about = np.unique(w.hashes[max(begin[p], start[p] - most) : min(end[p], start[p] + n + most)])
                    near = about[np.minimum(np.searchsorted(about, words), len(about) - 1)] == words
                    ok = found[near.sum(axis=1) >= n - most]
                    starts.append(np.full(len(ok), start[p]))
                    items.append(ok)
        return np.concatenate(starts), np.concatenate(items)

    def _verify(self, best: dict, w: K.Words, text_of: np.ndarray, start: np.ndarray, item: np.ndarray) -> None:
        """Exact edit distance about every candidate; neighbouring windows of one item are one region."""
        size = np.diff(self.a["first"])
        text, n, most = text_of[start], size[item], self.a["most"][item]
        new = np.ones(len(start), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + n[1:])
        heads = np.flatnonzero(new)
        for a, z in zip(heads.tolist(), np.append(heads[1:], len(start)).tolist(), strict=True):
            t, i, k = int(text[a]), int(item[a]), int(most[a])
            if best.get((t, i), (1,))[0] == 0:
                continue
            begin, end = int(w.first[t]), int(w.first[t + 1])
            lo, hi = max(begin, int(start[a]) - k), min(end, int(start[z - 1]) + int(n[a]) + k)
            if span := best_span(self.item(i), w.hashes[lo:hi], k):
                d, p, words = span
                found = (d, p + lo - begin, words)
                best[t, i] = min(best.get((t, i), found), found, key=lambda x: (x[0], x[1] + x[2], x[2]))


def write_index(benchmark: DataFrame, max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> list[str]:
    """Write the benchmark's parts, of at most ``block`` items each, to the shared folder; their names."""
    spark = benchmark.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    rows = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts = max(1, -(-rows.count() // block))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        task = TaskContext.get()
        names = []
        for lo in range(0, t.num_rows, block):
            part = t.slice(lo, block).combine_chunks()
            uri = f"{folder}/items-{task.partitionId()}-{lo}.idx"
            write_file(uri, index(part.column(0).chunk(0), part.column(1).chunk(0), max_edits, min_words))
            names.append(uri)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return sorted(r["file"] for r in rows.repartition(parts).mapInArrow(write, "file string").collect())


def contaminated(
    df: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, edits`` for each row and each item found in it."""
    files = write_index(benchmark, max_edits, min_words, item_col, item_text_col)
    rows = texts(df, id_col, text_col)
    kind, item = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    names = ["doc_id", "item_id", "first_word", "n_words", "edits"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(map_file(f), max_edits) for f in files]
        for b in K.blocks(batches, "text"):
            w = K.words(b.column(1), K.ALNUM)
            text_of = w.text_of()
            for part in parts:
                found = part.search(w, text_of) if len(w.hashes) else []
                if found:
                    t, i, p, n, d = (np.array(x) for x in zip(*found, strict=True))
                    # Every id of a distinct item.
                    at, owner = _ragged(part.a["own"][i], part.a["own"][i + 1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(t[owner])), part.ids.take(pa.array(at)).combine_chunks(),
                            pa.array(p[owner]), pa.array(n[owner]), pa.array(d[owner], pa.int32()),
                        ], names,
                    )

    return rows.mapInArrow(search, f"doc_id {kind}, item_id {item}, first_word long, n_words long, edits int")


def is_contaminated(
    text: Column, benchmark: DataFrame, max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS, item_col: str = "item_id", item_text_col: str = "text"
) -> Column:
    """True where a text holds any item; keeps all other columns as they are."""
    files = write_index(benchmark, max_edits, min_words, item_col, item_text_col)

    @F.arrow_udf("boolean")
    def found(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = [Part(map_file(f), max_edits) for f in files]
        for a in it:
            hits = [np.zeros(0, bool)]
            for p in K.blocks(iter([pa.RecordBatch.from_arrays([a], ["t"])]), "t"):
                w, hit = K.words(p.column(0), K.ALNUM), np.zeros(p.num_rows, bool)
                text_of = w.text_of()
                for part in parts if len(w.hashes) else ():
                    hit[[m[0] for m in part.search(w, text_of)]] = True
                hits.append(hit)
            yield pa.array(np.concatenate(hits))

    return found(F.coalesce(text, F.lit("")))
