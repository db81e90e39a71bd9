"""Byte-level BPE over Arrow batches: pieces found in NumPy, each encoded once by the library.

The tokenizer's pattern cuts a text into pieces (a word with its space, a number, a run
of signs, white space) and merges never cross them. So the pieces of a whole batch are
found by a table look-up per byte, hashed, and reduced to the distinct ones; those not
seen by this worker yet are encoded by the ``tokenizers`` library, and the ids of all
texts are gathered from that cache. A piece's bytes are compared with those that were
cached under its hash, so a collision can't change a result. The ids equal the library's
for the whole text.

Before anything else long texts are cut into segments of at most ``SEGMENT`` bytes, where
the pattern always ends a piece: before white space that follows a visible ASCII character
or, where there is none, between an ASCII letter or digit and another kind of ASCII sign;
never inside an added token's string. All that follows works on groups of segments, so
its memory doesn't depend on a text's length. A run without any such place (one word of
many megabytes, or a script without spaces and ASCII) stays one segment, as it is one piece
to the library too.

Segments with characters whose class could depend on the library's Unicode version, with
white space outside ASCII, or with a string of an added token go to the library, each on
its own. A tokenizer with another pattern, a normalizer, or added tokens that take in
white space is given whole texts. The cache is bounded and starts anew when full, which
changes no result; a worker keeps one tokenizer at a time.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textkit as K

CACHE = 500_000
SEGMENT = 1 << 19
GROUP = 1 << 20
SPACE, LETTER, NUMBER, OTHER, ODD = 0, 1, 2, 3, 4
#: The pattern whose pieces ``pieces`` finds; a file with another one is encoded whole.
_ASCII = np.full(256, OTHER, np.uint8)
_ASCII[[0x20, 9, 10, 11, 12, 13]] = SPACE
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = LETTER
_ASCII[0x30:0x3A] = NUMBER
_ASCII[0x1C:0x20] = ODD  # separators: white space to some libraries only
_LIMIT = 0x3000
_codes: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point below the limit; ODD where classes may differ by version."""
    global _codes
    if _codes is None:
        _codes = np.full(_LIMIT, ODD, np.uint8)
        for lo, hi in ((0xA1, 0x250), (0x370, 0x530), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20BE), (0x2100, 0x2400)):
            for c in range(lo, hi):
                k = unicodedata.category(chr(c))
                if k[0] == "L":
                    _codes[c] = LETTER
                elif k[0] == "N":
                    _codes[c] = NUMBER
                elif k != "Cn" and k[0] != "Z" and k[0] != "M":
                    _codes[c] = OTHER
    return _codes


def _classify(data: np.ndarray) -> np.ndarray:
    c = _ASCII[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        b = data[high].astype(np.int64)
        at = lambda k: data[np.minimum(high + k, len(data) - 1)].astype(np.int64) & 0x3F
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        code = np.where(two, (b & 0x1F) << 6 | at(1), np.where(three, (b & 0x0F) << 12 | at(1) << 6 | at(2), _LIMIT))
        k = np.where(code < _LIMIT, _classes()[np.minimum(code, _LIMIT - 1)], ODD).astype(np.uint8)
        c[high] = k
        for j, m in ((1, b >= 0xC0), (2, b >= 0xE0), (3, b >= 0xF0)):
            c[np.minimum(high[m] + j, len(data) - 1)] = k[m]
    return c


def pieces(data: np.ndarray, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece of texts laid end to end; a piece ends where the next starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = c[1:] != c[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    new[begins] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    kind = c[runs]
    text_first = np.zeros(n + 1, bool)
    text_first[begins] = True
    text_first[n] = True
    start = np.zeros(n, bool)
    start[runs] = True
    # White space before more text: its last space joins what follows, another sign stands alone.
    inner = (kind == SPACE) & ~text_first[ends]
    start[ends[inner] - 1] = True
    joins = inner & (data[ends - 1] == 0x20)
    start[ends[joins]] = False
    # An apostrophe alone, not joined to a space, before s, t, m, d, re, ve or ll.
    mark = np.flatnonzero((kind == OTHER) & (ends - runs == 1) & (data[runs] == 0x27) & start[runs])
    mark = mark[mark + 1 < len(runs)]
    mark = mark[(kind[mark + 1] == LETTER) & ~text_first[runs[mark + 1]]]
    if len(mark):
        p, stop = ends[mark], ends[mark + 1]
        a, b = data[p], np.where(p + 1 < stop, data[np.minimum(p + 1, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        step = np.where(one, 1, np.where(two, 2, 0))
        ok = step > 0
        start[p[ok]] = False
        rest = (p + step)[ok]
        rest = rest[rest < stop[ok]]
        start[rest] = True
    return np.flatnonzero(start)


_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def safe_cut(part: np.ndarray, most: int, added: list[bytes]) -> int:
    """The last of the first ``most`` places of these bytes where a piece always ends, 0 where there is none."""
    left, right = part[: most - 1], part[1:most]
    a, b = _ASCII[left], _ASCII[right]
    kinds = [_VISIBLE[left] & (b == SPACE), ((a == LETTER) | (a == NUMBER)) & _VISIBLE[right] & (a != b)]
    for ok in kinds:
        for p in (np.flatnonzero(ok)[::-1] + 1).tolist():
            if not any(x in part[max(0, p - len(x) + 1) : p + len(x) - 1].tobytes() for x in added):
                return p
    return 0


def cuts(data: np.ndarray, offsets: np.ndarray, most: int = SEGMENT, added: list[bytes] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Offsets with long texts cut at safe boundaries, and the text of each segment."""
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= most:
        return offsets, np.arange(len(sizes))
    beyond = max(map(len, added), default=0)  # a token may begin before a place and end after the last
    at, owner = [0], []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        reach = most
        while hi - lo > reach:
            p = safe_cut(data[lo : min(hi, lo + reach + beyond)], reach, added)
            if not p:
                reach *= 2  # nothing here: a longer segment
                continue
            lo, reach = lo + p, most
            at.append(lo)
            owner.append(i)
        at.append(hi)
        owner.append(i)
    return np.array(at), np.array(owner)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, end to end."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


class Encoder:
    """One worker's tokenizer and its cache of encoded pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        )
        tokens = spec.get("added_tokens", [])
        self.added = [a["content"].encode() for a in tokens]
        self.plain &= not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or set(a["content"]) & set(" \t\n\r\v\f") for a in tokens)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.begin, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # the pieces' bytes, by order of learning
        self.turn = np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        raw = [x.encode() for x in strings]
        self.turn = np.insert(self.turn, np.searchsorted(self.keys, keys), len(self.begin) - 1 + np.arange(len(keys)))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in raw], dtype=np.int64)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def _look(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(u), np.int64), np.zeros(len(u), bool)
        k = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        return k, self.keys[k] == u

    def _same(self, data: np.ndarray, st: np.ndarray, en: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes that were learnt for it."""
        begin, size = self.begin[turn], en - st
        same = self.begin[turn + 1] - begin == size
        if same.all():
            differ = data[_places(st, size)] != self.text[_places(begin, size)]
            if differ.any():
                same[np.searchsorted(np.cumsum(size), np.flatnonzero(differ), "right")] = False
        return same

    def parts(self, texts: pa.Array, ids: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Segment by segment in groups: the text of each, its number of ids, and all their ids (none where ``ids`` is false)."""
        data, offsets = K.buffers(texts)
        seg, owner = cuts(data, offsets, SEGMENT, self.added) if self.plain else (offsets, np.arange(len(offsets) - 1))
        at = 0
        while at < len(owner):
            end = min(len(owner), max(at + 1, int(np.searchsorted(seg, seg[at] + GROUP, "right")) - 1))
            yield owner[at:end], *self._group(data[seg[at] : seg[end]], seg[at : end + 1] - seg[at], ids)
            at = end

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids end to end (none where ``ids`` is false)."""
        counts, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        for owner, n, x in self.parts(texts, ids):
            np.add.at(counts, owner, n)
            found.append(x)
        return counts, np.concatenate(found)

    def _group(self, data: np.ndarray, offsets: np.ndarray, ids: bool, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that stand end to end; those marked ``alone`` go to the library."""
        n_texts = len(offsets) - 1
        c = _classify(data)
        if alone is None:
            odd = np.concatenate(([0], np.cumsum(c == ODD)))
            alone = odd[offsets[1:]] > odd[offsets[:-1]] if self.plain else np.ones(n_texts, bool)
        raw = data.tobytes() if self.added else b""
        for a in self.added:
            p = raw.find(a)
            while p >= 0:
                alone[np.searchsorted(offsets, p, "right") - 1] = True
                p = raw.find(a, p + 1)
        del raw
        st = pieces(data, c, offsets)
        en = np.append(st[1:], len(data))
        doc = np.searchsorted(offsets, st, "right") - 1
        if alone.any():
            keep = ~alone[doc]
            st, en, doc = st[keep], en[keep], doc[keep]
        h = K.span_hashes(data, st, en, K.EXACT)
        u, where, back = np.unique(h, return_index=True, return_inverse=True)
        k, known = self._look(u)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > CACHE:
                self._clear()
                new = np.arange(len(u))
            view = memoryview(data)
            self._learn(u[new], [bytes(view[a:b]).decode() for a, b in zip(st[where[new]].tolist(), en[where[new]].tolist(), strict=True)])
            k, _ = self._look(u)
        same = self._same(data, st, en, self.turn[k][back])
        if not same.all():  # hashes that collide
            alone[doc[~same]] = True
            return self._group(data, offsets, ids, alone)
        size = self.size[k][back]
        counts = np.bincount(doc, size, n_texts).astype(np.int64)[:n_texts] if len(doc) else np.zeros(n_texts, np.int64)
        rest = {int(i): self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(alone)}
        for i, x in rest.items():
            counts[i] = len(x)
        if not ids:
            return counts, np.zeros(0, np.uint32)
        out = self.ids[_places(self.first[k][back], size)]
        if rest:
            own = np.where(alone, 0, counts)
            at = np.concatenate(([0], np.cumsum(own)))
            parts, last = [], 0
            for i in sorted(rest):
                parts += [out[last : at[i]], rest[i]]
                last = at[i]
            out = np.concatenate([*parts, out[last:]])
        return counts, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
