"""Elias-Fano sequences over NumPy arrays, with vectorised successor search.

A non-decreasing sequence keeps the low ``l`` bits of every value packed end to end, and
the high parts as a bit string in unary: value i sets bit (high_i + i). Directories over
the bit string's 64-bit words (how many ones, and how many zeros, stand before each, in 32
bits where that is enough) answer select in one binary search and one step within a word.
All parts are plain arrays, so a sequence can be memory-mapped as it lies on disk; nothing
is rebuilt when it is opened.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_1S, _3S, _5S = U64(0x0101010101010101), U64(0x3333333333333333), U64(0x5555555555555555)
_FS, _TOPS = U64(0x0F0F0F0F0F0F0F0F), U64(0x8080808080808080)
#: Place of the k-th one of every byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SELECT[_b, : _b.bit_count()] = [p for p in range(8) if _b >> p & 1]


def encode(values: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
    """The arrays of a sorted uint64 sequence, their names prefixed by ``name``."""
    n = len(values)
    top = int(values[-1]) if n else 0
    l = max(0, (top // n).bit_length() - 1) if n else 0
    low = values & U64((1 << l) - 1)
    bits = (values >> U64(l)).astype(np.int64) + np.arange(n)
    size = (int(bits[-1]) + 2) if n else 1
    upper = np.zeros((size + 63) // 64, U64)
    np.bitwise_or.at(upper, bits >> 6, U64(1) << (bits & 63).astype(U64))
    at = np.arange(n, dtype=np.int64) * l
    lower = np.zeros((n * l + 63) // 64 + 1, U64)
    if l:
        word, off = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(lower, word, low << off)
        spill = (off + U64(l)) > 64
        np.bitwise_or.at(lower, word[spill] + 1, low[spill] >> (U64(64) - off[spill]))
    kind = np.uint32 if len(upper) * 64 < 1 << 32 else np.int64
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)))
    zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
    return {
        f"{name}upper": upper, f"{name}lower": lower, f"{name}ones": ones.astype(kind), f"{name}zeros": zeros.astype(kind),
        f"{name}shape": np.array([n, l], np.int64),
    }


def _kth(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, by sideways addition of its bytes."""
    sums = words - ((words >> U64(1)) & _5S)
    sums = (sums & _3S) + ((sums >> U64(2)) & _3S)
    sums = ((sums + (sums >> U64(4))) & _FS) * _1S  # byte i: the ones of bytes 0 to i
    k = k.astype(U64)
    place = np.bitwise_count(((k * _1S | _TOPS) - sums) & _TOPS).astype(U64) * U64(8)
    rank = k - (((sums << U64(8)) >> place) & U64(0xFF))
    return (place + _SELECT[((words >> place) & U64(0xFF)).view(np.int64), rank.view(np.int64)]).view(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str = ""):
        self.upper, self.lower, self.ones, self.zeros = (arrays[f"{name}{k}"] for k in ("upper", "lower", "ones", "zeros"))
        self.n, self.l = (int(x) for x in arrays[f"{name}shape"])
        self.bytes = None
        if self.l <= 57 and self.lower.flags.c_contiguous:  # a value lies within eight bytes: one read from any byte on
            self.bytes = np.ndarray((self.lower.nbytes - 7,), "<u8", self.lower, 0, (1,))

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        at = i * self.l
        if self.bytes is not None:
            return self.bytes[at >> 3] >> (at & 7).astype(U64) & U64((1 << self.l) - 1)
        word, off = at >> 6, (at & 63).astype(U64)
        v = self.lower[word] >> off
        spill = np.where(off == 0, U64(0), self.lower[word + 1] << ((U64(64) - off) & U64(63)))
        return (v | spill) & U64((1 << self.l) - 1)

    def _word(self, directory: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(directory, i.astype(directory.dtype), "right") - 1

    def select1(self, i: np.ndarray) -> np.ndarray:
        w = self._word(self.ones, i)
        return w * 64 + _kth(self.upper[w], i - self.ones[w])

    def select0(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th zero; past the last, the end of the bit string."""
        w = np.minimum(self._word(self.zeros, i), len(self.upper) - 1)
        k = i - self.zeros[w]
        words = ~self.upper[w]
        ok = k < np.bitwise_count(words)
        out = np.full(len(i), len(self.upper) * 64, np.int64)
        out[ok] = w[ok] * 64 + _kth(words[ok], k[ok])
        return out

    def _value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (place - i).astype(U64) << U64(self.l) | self.low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        return self._value(self.select1(i), i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``i`` and ``i + 1``: the next one is mostly in the same word."""
        at = self.select1(i)
        off = (at & 63).astype(U64)
        rest = (self.upper[at >> 6] >> off) >> U64(1)
        after = at + 1 + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        after[far] = self.select1(i[far] + 1)
        return self._value(at, i), self._value(after, i + 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not less than each ``x`` (``n`` where there is none)."""
        return self._search(x)[0]

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Also where the values of each ``x``'s high part end."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        top = x >> U64(self.l)
        beyond = top >= U64(int(self.zeros[-1]))  # more than any value's high part
        high = np.where(beyond, U64(0), top).astype(np.int64)
        # Values of one high part are the ones between two zeros of the bit string.
        begin = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1, 0)
        lo = begin - high
        off = (begin & 63).astype(U64)
        rest = ~(self.upper[np.minimum(begin >> 6, len(self.upper) - 1)] >> off)
        ones = np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        hi = lo + ones
        far = np.flatnonzero(ones + off.view(np.int64) >= 64)
        hi[far] = self.select0(high[far]) - high[far]
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        lo[beyond] = hi[beyond] = self.n
        end = hi
        open_ = np.flatnonzero(lo < hi)
        want, a, z = (x & U64((1 << self.l) - 1))[open_], lo[open_], hi[open_]
        while len(open_):
            mid = (a + z) >> 1
            less = self.low(mid) < want
            a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
            lo[open_] = a
            more = a < z
            if not more.all():
                open_, want, a, z = open_[more], want[more], a[more], z[more]
        return lo, end

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each ``x`` and whether it is there; before its end the high part is equal, so the low bits decide."""
        i, end = self._search(x)
        ok = i < end
        k = np.flatnonzero(ok)
        ok[k] = self.low(i[k]) == x[k] & U64((1 << self.l) - 1)
        return i, ok


def encode_children(context: np.ndarray, successor: np.ndarray, n_contexts: int, name: str = "") -> dict[str, np.ndarray]:
    """One level of a trie: each context's sorted successors, and where they begin.

    A context's successors are stored relative to the last value before them, so that one
    sequence stays sorted through all contexts; ``ptr`` holds the contexts' first places.
    """
    first = np.searchsorted(context, np.arange(n_contexts + 1))
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    last = successor[first[full + 1] - 1]  # each context's greatest successor
    base = np.concatenate((np.zeros(1, U64), np.cumsum(last)))[: len(full)]
    values = successor + np.repeat(base, sizes[full])
    return encode(first.astype(U64), f"{name}ptr_") | encode(values, f"{name}succ_")


class Children:
    """Look-up in such a level."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str = ""):
        self.ptr, self.succ = EliasFano(arrays, f"{name}ptr_"), EliasFano(arrays, f"{name}succ_")

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each successor in its context's own range, and whether it is there; contexts ascend."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        own = context[new]
        lo, hi = (x.view(np.int64) for x in self.ptr.get_two(own))
        base, only = np.zeros(len(own), U64), np.zeros(len(own), U64)
        later = np.flatnonzero((lo > 0) & (lo < hi))
        base[later], only[later] = self.succ.get_two(lo[later] - 1)
        front = np.flatnonzero((lo == 0) & (lo < hi))
        only[front] = self.succ.get(lo[front])
        of = np.cumsum(new) - 1
        i, want = lo[of], successor + base[of]
        ok = only[of] == want  # the first successor, which is mostly the only one
        ok &= (lo < hi)[of]
        at = np.flatnonzero((hi - lo > 1)[of] & (only[of] < want))
        found, there = self.succ.find(want[at])  # after the first one, which is less
        inside = np.flatnonzero(there & (found < hi[of[at]]))
        at = at[inside]
        i[at] = found[inside]
        ok[at] = True
        return i, ok
