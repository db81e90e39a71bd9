"""Language-model scoring: an Elias-Fano n-gram trie, mapped from shared files.

Texts are sequences of words (A-Z lower-cased) with one end token each, which also stands
before the first word. The model is a trigram, smoothed from order to order by a Dirichlet
prior: ``p(w | u, v) = (c(u, v, w) + M3 * p(w | v)) / (c(u, v) + M3)``, ``p(w | v)`` in the
same way with ``M2`` over the add-0.1 unigram ``p(w)`` below. It sums to one over the
vocabulary and one unknown word. At a text's first word the order is two.

The trie has three levels. Level 1 is the vocabulary: word hashes in Elias-Fano form; a
word's id is its rank there. On level 2 a node is a word after another, on level 3 a word
after such a pair. A level stores every context's successors, relative to the last value
before them and so in one sorted Elias-Fano sequence, and, again Elias-Fano coded, the
monotone pointers to where each context's successors begin. A look-up reads a context's two
pointers and searches the successor within that range alone (:mod:`elias_fano`). Beside each
node stand its smoothed log probability and, where it can be a context, the weight it gives
to the lower order, both quantised to 16 bits. Level 1 has exact counts too, for the base.

Building is one pass over the training texts for each level. A task reduces every
``FLUSH`` keys (context, successor) to distinct ones with counts and sends those of each
bucket as one packed run, a row that is never shorter than a key's own would be; Spark
shuffles and sorts the runs by bucket, and each partition adds up one bucket at a time and
writes its file. A bucket is a range of contexts with about ``BUCKET_TOKENS`` / 2 tokens,
and a context too frequent for one is dealt over several by successor, by its count; so
neither a bucket nor a task's memory grows with the corpus, only the number of buckets
does. Files lie in the shared folder, written under a temporary name and renamed; each
Python worker maps them. No model part passes through the driver but one small row a file.

Null and empty texts have the end token alone. Rows are scored one by one; repeated rows
count as often as they occur. Of the input only the id and the text are read. An empty
table gives no rows; without training texts every word is unknown. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .elias_fano import Children, EliasFano, encode, encode_children
from .shared import drop_shuffles, map_file, remove, shared_folder, small_batches, texts, write_file

M2, M3 = 40.0, 10.0
BUCKET_TOKENS = 3_000_000
MAPPED = 8192  # files that a worker holds mapped at once
BLOCK = 2 << 20  # bytes of text looked at at once
FLUSH = 2_000_000
ROWS = 8000  # of a batch, which is bounded by bytes as well: the more n-grams at once, the nearer their places in the files
END = np.uint64(0x0F1E2D3C4B5A6978)
QUANT = 4096.0  # steps per unit of log10, over 16 bits
WORD_BITS = 37  # of a key's 63 bits; the others hold the context's place in its bucket
U64 = np.uint64


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, the end token included, and each text's first one."""
    w = K.words(text)
    n = w.counts()
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.empty(first[-1], U64)
    out[np.arange(len(w.hashes)) + w.text_of()] = w.hashes
    out[first[1:] - 1] = END
    return out, first


def quantised(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logp * QUANT), 0, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q / -QUANT


class Maps(OrderedDict):
    """Mapped files by name, the least recently used put away first."""

    def of(self, uri: str, make: Callable[[dict], Any]) -> Any:
        if uri in self:
            self.move_to_end(uri)
        else:
            self[uri] = make(map_file(uri))
            if len(self) > MAPPED:
                self.popitem(last=False)
        return self[uri]

    def __reduce__(self):
        return (Maps, ())


@dataclass
class Vocabulary:
    """Level 1: shards of sorted word hashes; shard s holds those with top bits s."""

    folder: str
    sizes: np.ndarray
    train_tokens: int
    maps: Maps = field(default_factory=Maps, repr=False)

    def __post_init__(self) -> None:
        self.bases = np.cumsum(self.sizes) - self.sizes
        self.total = int(self.sizes.sum())
        self.bits = max(0, (len(self.sizes) - 1).bit_length())

    def shard(self, s: int) -> tuple[EliasFano, dict[str, np.ndarray]]:
        return self.maps.of(f"{self.folder}/words-{s}.ef", lambda m: (EliasFano(m), m))

    def look(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, -1 for unknown words."""
        ids = np.full(len(h), -1, np.int64)
        edges = np.searchsorted(h, np.arange(1, len(self.sizes), dtype=U64) << U64(64 - self.bits)) if self.bits else np.zeros(0, np.int64)
        edges = np.concatenate(([0], edges, [len(h)]))
        for s in np.flatnonzero(self.sizes).tolist():
            a, b = edges[s], edges[s + 1]
            if a < b:
                i, ok = self.shard(s)[0].find(h[a:b] & U64((1 << (64 - self.bits)) - 1))
                ids[a + np.flatnonzero(ok)] = self.bases[s] + i[ok]
        return ids

    def columns(self, ids: np.ndarray, *names: str) -> list[np.ndarray]:
        """Stored values (``count``, ``prob``, ``back``) of each word by id; 0 for unknown words."""
        u, of = ids, None
        if (ids[1:] < ids[:-1]).any():
            u, of = np.unique(ids, return_inverse=True)
        out = [np.zeros(len(u), np.int64 if name == "count" else float) for name in names]
        edges = np.append(np.searchsorted(u, self.bases), len(u))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, z = edges[s], edges[s + 1]
            for o, name in zip(out, names, strict=True):
                v = self.shard(s)[1][name][u[a:z] - self.bases[s]]
                o[a:z] = v if name == "count" else restored(v)
        return out if of is None else [o[of] for o in out]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.train_tokens + 0.1 * (self.total + 1)))


@dataclass
class Buckets:
    """Ranges of contexts; hot contexts have buckets of their own, by ranges of the successor."""

    starts: np.ndarray  # first context of each range
    contexts: int
    successors: int
    hot: np.ndarray  # contexts, sorted
    parts: np.ndarray  # in how many buckets each is dealt

    def __post_init__(self) -> None:
        self.first = len(self.starts) + np.cumsum(self.parts) - self.parts
        self.count = len(self.starts) + int(self.parts.sum())

    @staticmethod
    def of_counts(starts: np.ndarray, contexts: int, successors: int, hot: list[tuple[int, int]]) -> Buckets:
        pairs = np.array(sorted(hot), np.int64).reshape(-1, 2)
        return Buckets(starts, contexts, successors, pairs[:, 0], 1 + 4 * pairs[:, 1] // BUCKET_TOKENS)

    def of(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.starts, context, "right") - 1
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            m = self.hot[k] == context
            out[m] = self.first[k[m]] + successor[m] * self.parts[k[m]] // self.successors
        return out

    def range(self, bucket: int) -> tuple[int, int]:
        """The contexts that a bucket may hold."""
        if bucket < len(self.starts):
            return int(self.starts[bucket]), int(self.starts[bucket + 1]) if bucket + 1 < len(self.starts) else self.contexts
        c = int(self.hot[np.searchsorted(self.first, bucket, "right") - 1])
        return c, c + 1

    def first_of(self, bucket: np.ndarray) -> np.ndarray:
        """The first context of each bucket."""
        out = self.starts[np.minimum(bucket, len(self.starts) - 1)]
        m = bucket >= len(self.starts)
        out[m] = self.hot[np.searchsorted(self.first, bucket[m], "right") - 1]
        return out


@dataclass
class Level:
    """Level 2 or 3: a file for each bucket that has nodes; a node's id is its rank through all buckets."""

    name: str
    buckets: Buckets
    sizes: np.ndarray
    maps: Maps = field(default_factory=Maps, repr=False)

    def __post_init__(self) -> None:
        self.bases = np.cumsum(self.sizes) - self.sizes

    def file(self, bucket: int) -> tuple[Children, dict[str, np.ndarray]]:
        return self.maps.of(f"{self.name}-{bucket}.ef", lambda m: (Children(m), m))

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (-1 where there is none), probabilities and back-off weights of (context, successor), sorted and distinct."""
        node, prob, back = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.zeros(len(context))
        bucket = self.buckets.of(context, successor)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[a:z]
            b = int(bucket[rows[0]])
            if not self.sizes[b]:
                continue
            children, m = self.file(b)
            i, ok = children.find(context[rows] - self.buckets.range(b)[0], successor[rows].astype(U64))
            rows, i = rows[ok], i[ok]
            node[rows], prob[rows] = self.bases[b] + i, restored(m["prob"][i])
            if "back" in m:
                back[rows] = restored(m["back"][i])
        return node, prob, back


def distinct(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, the pair of each place, and how often each occurs; ``b`` is below ``limit``."""
    places = len(a).bit_length()
    top = (int(a.max()) + 1) * limit if len(a) else 0
    if len(a) and top < 1 << (64 - places):  # pair and place in one number: sorting numbers is far quicker than ordering places
        key = (a * limit + b).view(U64) << U64(places) | np.arange(len(a), dtype=U64)
        key.sort()
        place = (key & U64((1 << places) - 1)).view(np.int64)
        key >>= U64(places)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        of = np.empty(len(a), np.int64)
        of[place] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        u = key[at].view(np.int64)
        return *np.divmod(u, limit), of, np.diff(np.append(at, len(a)))
    if not len(a) or top < 1 << 63:
        u, of, n = np.unique(a * limit + b, return_inverse=True, return_counts=True)
        return u // limit, u % limit, of, n
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return x[at], y[at], of, np.diff(np.append(at, len(a)))


def words_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the one of each place; only the distinct ones are sorted."""
    d = pa.array(h.view(np.int64)).dictionary_encode()
    u = d.dictionary.to_numpy().view(U64)
    order = np.argsort(u)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return u[order], rank[d.indices.to_numpy()]


@dataclass
class Model:
    vocabulary: Vocabulary
    pairs: Level
    triples: Level | None = None  # while level 3 is built

    def nodes(self, h: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Per token: its word and pair, as places among the distinct ones; its ids; its level 2 node with what was read there.

        Pairs lie in the order of their nodes within each level 2 file, words in that of their ids.
        """
        v = self.vocabulary
        u, of = words_of(h)
        uid = v.look(u)
        ids = uid[of]
        before = np.empty(len(h), np.int64)
        if len(h):
            before[1:] = of[:-1]
            before[first[:-1]] = of[first[1] - 1]
        context = uid[before]
        node, prob, back = np.full(len(h), -1, np.int64), np.zeros(len(h)), np.zeros(len(h))
        both = np.flatnonzero((context >= 0) & (ids >= 0))
        # Words of this block in the order of their ids: smaller numbers, in the same order.
        c, s, at, _ = distinct(before[both], of[both], max(1, len(u)))
        found = self.pairs.find(uid[c], uid[s])
        node[both], prob[both], back[both] = (x[at] for x in found)
        pair = np.full(len(h), -1, np.int64)
        pair[both] = at
        return {"u": uid, "of": of, "id": ids, "context": context, "pair": pair, "nodes": found[0], "node": node, "prob": prob, "back": back}

    @staticmethod
    def followed(t: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (node, word id) of the tokens ``at`` after their pairs, which of them each token has, and how often each occurs."""
        c, s, of, n = distinct(t["pair"][at - 1], t["of"][at], max(1, len(t["u"])))
        return t["nodes"][c], t["u"][s], of, n

    def score(self, text: pa.Array) -> dict[str, np.ndarray]:
        h, first = tokens(text)
        t, v = self.nodes(h, first), self.vocabulary
        count, logp, weight = v.columns(t["u"], "count", "prob", "back")
        base = v.unigram(count)
        # Order by order: the stored probability where the n-gram is, else the lower order by the context's weight.
        logp = np.where(count > 0, logp, base)[t["of"]]
        weight = weight[t["of"]]
        known = t["context"] >= 0
        shifted = np.zeros(len(h))
        if len(h):
            shifted[1:] = weight[:-1]
            shifted[first[:-1]] = weight[first[1] - 1]
        logp = np.where(t["node"] >= 0, t["prob"], logp + np.where(known, shifted, 0.0))
        inner = np.ones(len(h), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        at = at[t["node"][at - 1] >= 0]
        fallback = logp[at] + t["back"][at - 1]
        seen = np.flatnonzero(t["node"][at] >= 0)  # without the pair there is no triple
        c, s, of, _ = self.followed(t, at[seen])
        node, prob, _ = self.triples.find(c, s)
        fallback[seen] = np.where(node[of] >= 0, prob[of], fallback[seen])
        logp[at] = fallback
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
        return {"n_tokens": np.diff(first), "n_known": add((count > 0).astype(np.int64)[t["of"]]), "base": add(base[t["of"]]), "score": add(logp)}


RUNS = "bucket long, run binary"
MADE = "bucket long, size long, tokens long, hot array<long>, hot_n array<long>"


def _bytes(a: np.ndarray) -> tuple[bytes, int]:
    """Non-negative numbers in as few bytes each as the largest needs."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def _packed(key: np.ndarray, *columns: np.ndarray) -> bytes:
    """A sorted run: steps between contexts, words and further columns, each in its own width."""
    context, word = key >> U64(WORD_BITS), key & U64((1 << WORD_BITS) - 1)
    parts = [_bytes(x) for x in (np.diff(context, prepend=U64(0)), word, *columns)]
    return bytes([len(parts), *(w for _, w in parts)]) + len(key).to_bytes(8, "little") + b"".join(p for p, _ in parts)


def _unpacked(run: bytes) -> list[np.ndarray]:
    widths = run[1 : 1 + run[0]]
    at, out = 1 + len(widths) + 8, []
    size = int.from_bytes(run[at - 8 : at], "little")
    for width in widths:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(run, np.uint8, size * width, at).reshape(size, width)
        out.append(wide.view("<u8")[:, 0])
        at += size * width
    return [np.cumsum(out[0], dtype=U64) << U64(WORD_BITS) | out[1], *(x.view(np.int64) for x in out[2:])]


def _runs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has keys: (key, count, ...), sorted by key within their bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, *columns = (x[order] for x in (bucket, *columns))
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
    for lo in range(0, len(edges) - 1, 4096):
        spans = list(zip(edges[lo : lo + 4096], edges[lo + 1 : lo + 4097], strict=False))
        rows = [_packed(*(c[a:z] for c in columns)) for a, z in spans]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array(rows, pa.binary())], ["bucket", "run"])


def _added(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The keys of several runs, sorted, each once, with their summed counts; further columns depend on the key alone."""
    key, n, *more = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return [key[new], np.add.reduceat(n[order], new) if len(new) else n, *(x[order[new]] for x in more)]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Buckets with their keys and counts, from runs sorted by bucket; one bucket is held at a time."""
    held: list[list[np.ndarray]] = []
    now, size, limit = -1, 0, FLUSH
    for b in batches:
        for bucket, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now:
                if held:
                    yield now, *_added(held)
                held, now, size, limit = [], bucket, 0, FLUSH
            held.append(_unpacked(run.as_py()))
            size += len(held[-1][0])
            if size > limit:
                held = [_added(held)]
                size = len(held[0][0])
                limit = 2 * size + FLUSH
    if held:
        yield now, *_added(held)


def _counted(parts: Iterator[tuple[np.ndarray, ...]], send: Callable[..., Iterator[pa.RecordBatch]], limit: int) -> Iterator[pa.RecordBatch]:
    """Adds up (context, word, count) of several blocks before they are sent."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        c, w, n = held[0]
        if len(held) > 1:
            c, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            c, w, of, _ = distinct(c, w, limit)
            n = np.bincount(of, n, len(c)).astype(np.int64)
        yield from send(c, w, n)

    for p in parts:
        held.append(p)
        if sum(len(x[0]) for x in held) > FLUSH:
            yield from flush()
            held = []
    if held:
        yield from flush()


def train(rows: DataFrame, text_col: str = "text") -> Model:
    """Build the model of ``rows``' texts in the shared folder."""
    spark = rows.sparkSession
    small_batches(spark, ROWS)
    folder = shared_folder(spark)
    text = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def built(count: Callable, write: Callable, buckets: int) -> list:
        """Runs one pass: keys with counts, sorted by bucket and key, to one file a bucket."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, *columns in _streams(batches):
                size, tokens_, hot, hot_n = write(bucket, *columns)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                row = (bucket, size, tokens_, hot, hot_n)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["bucket", "size", "tokens", "hot", "hot_n"])

        dealt = text.mapInArrow(count, RUNS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        rows = dealt.mapInArrow(made, MADE).collect()
        del dealt
        drop_shuffles(spark)
        return rows

    def sizes(made: list, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        out[[r["bucket"] for r in made]] = [r["size"] for r in made]
        return out

    # About one token for every six bytes; the number of shards is a power of two.
    size = text.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = 1 << max(0, (size // 6 // BUCKET_TOKENS).bit_length())
    bits = U64(shards.bit_length() - 1)
    mask = U64((1 << (64 - int(bits))) - 1)
    frequent = BUCKET_TOKENS // 8

    # Level 1 has one context; a hash's two parts stand for context and word.
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in K.blocks(batches, "text", 2 * BLOCK):
                h, n = np.unique(tokens(b.column(0))[0], return_counts=True)
                yield (h >> U64(32)).view(np.int64), (h & U64(0xFFFFFFFF)).view(np.int64), n

        def send(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            h = high.view(U64) << U64(32) | low.view(U64)
            bucket = (h >> (U64(64) - bits)).view(np.int64) if bits else np.zeros(len(h), np.int64)
            yield from _runs(bucket, h & mask, n)

        yield from _counted(parts(), send, 1 << 32)

    def write_words(bucket: int, key: np.ndarray, n: np.ndarray) -> tuple:
        # The unigram and its weight need totals, which are not known yet: counts first.
        write_file(f"{folder}/counts-{bucket}.ef", {"h": key, "count": n})
        hot = np.flatnonzero(n > frequent)  # few, as all counts sum to all tokens
        return len(key), int(n.sum()), hot.tolist(), n[hot].tolist()

    made = built(count_words, write_words, shards)
    n_words, n_tokens = sizes(made, shards), sum(r["tokens"] for r in made)
    vocabulary = Vocabulary(folder, n_words, n_tokens)

    def finish_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                m = map_file(f"{folder}/counts-{s}.ef")
                n = np.asarray(m["count"])
                kind = np.uint32 if int(n.max()) < 1 << 32 else np.int64
                write_file(
                    f"{folder}/words-{s}.ef",
                    {**encode(m["h"]), "count": n.astype(kind), "prob": quantised(vocabulary.unigram(n)), "back": quantised(np.log10(M2 / (n + M2)))},
                )
            yield b

    if made:
        spark.createDataFrame([(r["bucket"],) for r in made], "s long").repartition(len(made)).mapInArrow(finish_words, "s long").count()
        for r in made:
            remove(f"{folder}/counts-{r['bucket']}.ef")

    v = max(1, vocabulary.total)
    ranges = max(1, min(v, int(n_tokens // BUCKET_TOKENS) * 2))
    hot = [(int(vocabulary.bases[r["bucket"]]) + h, c) for r in made for h, c in zip(r["hot"], r["hot_n"], strict=True)]
    buckets = Buckets.of_counts(np.arange(ranges) * v // ranges, v, v, hot)

    def sent(buckets: Buckets) -> Callable[..., Iterator[pa.RecordBatch]]:
        def send(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = buckets.of(context, word)
            yield from _runs(bucket, ((context - buckets.first_of(bucket)) << WORD_BITS | word).view(U64), n)

        return send

    def split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> U64(WORD_BITS)).view(np.int64), key & U64((1 << WORD_BITS) - 1)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in K.blocks(batches, "text", 2 * BLOCK):
                h, first = tokens(b.column(0))
                u, of = words_of(h)
                ids = vocabulary.look(u)
                before = np.empty_like(of)
                before[1:] = of[:-1]
                before[first[:-1]] = of[first[1] - 1]
                c, s, _, n = distinct(before, of, len(u))
                yield ids[c], ids[s], n

        yield from _counted(parts(), sent(buckets), v)

    def write_pairs(bucket: int, key: np.ndarray, n: np.ndarray) -> tuple:
        context, word = split(key)
        lo, hi = buckets.range(bucket)
        p = 10.0 ** vocabulary.columns(word.view(np.int64), "prob")[0]
        total = vocabulary.columns(context + lo, "count")[0]
        prob = np.log10((n + M2 * p) / (total + M2))
        arrays = encode_children(context, word, hi - lo) | {"prob": quantised(prob), "back": quantised(np.log10(M3 / (n + M3)))}
        write_file(f"{folder}/pairs-{bucket}.ef", arrays)
        hot = np.flatnonzero(n > frequent)
        return len(key), 0, hot.tolist(), n[hot].tolist()

    made = built(count_pairs, write_pairs, buckets.count)
    pairs = Level(f"{folder}/pairs", buckets, sizes(made, buckets.count))
    partial = Model(vocabulary, pairs)
    n_pairs = max(1, int(pairs.sizes.sum()))
    hot = [(int(pairs.bases[r["bucket"]]) + h, c) for r in made for h, c in zip(r["hot"], r["hot_n"], strict=True)]
    starts = np.unique(np.append(0, pairs.bases[pairs.sizes > 0]))
    nodes = Buckets.of_counts(starts, n_pairs, v, hot)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, "text", 3 * BLOCK):
            h, first = tokens(b.column(0))
            t = partial.nodes(h, first)
            inner = np.ones(len(h), bool)
            inner[first[:-1]] = False
            at = np.flatnonzero(inner)
            c, s, of, n = partial.followed(t, at)
            lower = np.zeros(len(c), np.int64)
            lower[of] = quantised(t["prob"][at])  # of the word after the pair's second word alone
            bucket = nodes.of(c, s)
            yield from _runs(bucket, ((c - nodes.first_of(bucket)) << WORD_BITS | s).view(U64), n, lower)

    def write_triples(bucket: int, key: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple:
        context, word = split(key)
        lo, hi = nodes.range(bucket)
        of = int(np.searchsorted(pairs.bases, lo, "right")) - 1  # the level 2 file that has these contexts
        back = restored(pairs.file(of)[1]["back"][context + (lo - pairs.bases[of])])
        # The weight is M3 / (count of the context + M3).
        prob = back + np.log10(n / M3 + 10.0 ** restored(lower))
        write_file(f"{folder}/triples-{bucket}.ef", encode_children(context, word, hi - lo) | {"prob": quantised(prob)})
        return len(key), 0, [], []

    made = built(count_triples, write_triples, nodes.count)
    return Model(vocabulary, pairs, Level(f"{folder}/triples", nodes, sizes(made, nodes.count)))


def score_column(model: Model, text: Column) -> Column:
    """A struct of ``n_tokens, n_known, base_score, score`` for each text."""

    @F.arrow_udf("n_tokens long, n_known long, base_score double, score double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_tokens", "n_known", "base", "score"]
        for a in it:
            parts = [model.score(p.column(0)) for p in K.blocks(iter([pa.RecordBatch.from_arrays([a], ["t"])]), "t", 4 * BLOCK)]
            cols = [np.concatenate([p[k] for p in parts] or [np.zeros(0)]) for k in names]
            yield pa.StructArray.from_arrays(
                [pa.array(c.astype(np.int64 if j < 2 else float)) for j, c in enumerate(cols)], ["n_tokens", "n_known", "base_score", "score"]
            )

    return score(F.coalesce(text, F.lit("")))


def lm_score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    small_batches(df.sparkSession, ROWS)
    rows = texts(df, id_col, text_col).select("doc_id", score_column(model, F.col("text")).alias("s"))
    return rows.select("doc_id", "s.n_tokens", "s.n_known", F.lit(model.vocabulary.train_tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")
