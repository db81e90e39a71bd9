"""NumPy kernels over Arrow string buffers: words, word hashes, n-word shingles.

A text column arrives in Python as one byte buffer with offsets. The kernels work on
that buffer directly: a table look-up per byte finds words, a running sum gives every
word's 64-bit hash, and no Python object is made per word. Blocks of about ``BLOCK``
bytes keep the temporaries in the processor's cache whatever the batch holds; a block
always ends between words, so texts of any length are cut safely.

Hashes are seeded, so they are equal in every process. Two different words share one
with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U64 = np.uint64
_rng = np.random.default_rng(20240607)
_MULT = U64(int(_rng.integers(1, 1 << 62)) * 2 + 1)
_MULT_INV = U64(pow(int(_MULT), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

#: Byte tables: 1 where a byte belongs to a word.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, 9, 10, 11, 12, 13]] = 0
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = 1
ALNUM[0x80:] = 1

#: Byte values for hashing with A-Z read as a-z, and as they stand.
LOWER = _BYTE.copy()
LOWER[0x41:0x5B] = LOWER[0x61:0x7B]
EXACT = _BYTE

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        up, down = np.full(size, _MULT, U64), np.full(size, _MULT_INV, U64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits, in place where it can."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    return h


def seeded(text: str) -> int:
    """A word's hash as the kernels compute it, for look-up tables built on the driver."""
    return int(words(pa.array([text]), np.ones(256, np.uint8), EXACT).hashes[0])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of texts: their hashes, byte spans, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has words first[i] to first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, cuts: tuple[int, ...] = ()):
    """Hash of each span of bytes; spans lie within ``data``, ascending, not overlapping.

    With ``cuts``, also the hashes of each span's first ``k`` bytes for every cut ``k``
    (of the whole span where it is shorter): one array per cut, beside the first.
    """
    out = [np.empty(len(starts), U64) for _ in range(1 + len(cuts))]
    if not len(starts):
        return out if cuts else out[0]
    up, down = powers(min(len(data), BLOCK) + 1)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        until = max(done + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[until - 1])
        if high - low + 1 > len(up):
            up, down = powers(high - low + 1)
        run = values[data[low:high]]
        run *= up[: high - low]
        total = np.empty(high - low + 1, U64)
        total[0] = 0
        np.cumsum(run, out=total[1:])
        s, e = starts[done:until] - low, ends[done:until] - low
        at, back = total[s], down[s]
        for k, o in zip((0, *cuts), out, strict=True):
            h = total[np.minimum(s + k, e) if k else e]
            h -= at
            h *= back
            o[done:until] = h
        done = until
    out = [mix(o) for o in out]
    return out if cuts else out[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words, texts kept apart."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= inside[:-1] ^ 1
    finishes[:-1] &= inside[1:] ^ 1
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    last = np.append(full[1:], len(data)) - 1
    finishes[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def words(texts: pa.Array, table: np.ndarray = SPACED, values: np.ndarray = LOWER) -> Words:
    """All words of all texts."""
    data, offsets = buffers(texts)
    starts, ends = word_spans(data, offsets, table)
    first = np.searchsorted(starts, offsets)
    return Words(span_hashes(data, starts, ends, values), starts, ends, first)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` hashes from each place on; the last ``n - 1`` places have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out *= U64(0x9E3779B97F4A7C15)
        out += hashes[j : j + m]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles, sorted within each text, and each text's first one.

    A text with fewer words has its whole sequence as its one shingle; one without words
    has none.
    """
    count = w.counts()
    every = runs(w.hashes, n)
    parts, sizes = [], np.zeros(len(count), np.int64)
    for i, (lo, c) in enumerate(zip(w.first[:-1].tolist(), count.tolist(), strict=True)):
        if c >= n:
            s = np.unique(every[lo : lo + c - n + 1])
        elif c:
            s = mix(np.array([int(runs(w.hashes[lo : lo + c], c)[0]) ^ (c * 0x51ED27)], U64))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
