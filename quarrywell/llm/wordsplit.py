"""Vectorised splitting of whole texts into the units that tokenizers treat independently.

A chunk of texts becomes one array of UTF-8 bytes; a class table and differences give the unit boundaries, and
Arrow's dictionary encoding gives the distinct units.  An encoder is then asked once per distinct unit, not
once per occurrence.

Only texts whose code points are all below ``SAFE`` and hold no control characters besides white space go
this way; for these the class tables are certain.  ``odd_texts`` tells which texts they are not; callers let the
library split those.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SAFE = 0x300  # below it: no combining marks, so NFC changes nothing
SEP, WS, LETTER, NUMBER, OTHER, BAD = 0, 1, 2, 3, 4, 9
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
CHUNK = 2_000_000  # bytes handled at once


def _classes() -> np.ndarray:
    out = np.full(SAFE, OTHER, np.uint8)
    for c in range(SAFE):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else BAD if kind == "Cc" else OTHER
    out[list(WHITE)] = WS
    return out


CLASS = _classes()
LEAD_TOP = 0xC0 | (SAFE >> 6)  # first lead byte that stands for code points beyond the tables
_BYTE = np.concatenate([CLASS[:128], np.full(128, BAD, np.uint8)])


@dataclass
class Units:
    """The units of a chunk of texts, and of each the number of its distinct unit and of its text."""

    words: list[bytes]
    kind: np.ndarray
    doc: np.ndarray


def _class_of(raw: np.ndarray) -> np.ndarray:
    cls = _BYTE[raw]
    cls[raw == 0] = SEP
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first, second = raw[lead].astype(np.int64), raw[np.minimum(lead + 1, len(raw) - 1)].astype(np.int64)
        fine = first < LEAD_TOP
        at, code = lead[fine], ((first[fine] & 31) << 6) | (second[fine] & 63)
        cls[at] = cls[at + 1] = CLASS[code]
    return cls


def odd_texts(texts: list[bytes], marker: bytes = b"<|") -> list[bool]:
    """For each text, whether it holds a byte outside the tables, a null character or the marker."""
    joined = b"".join(texts)
    odd = [False] * len(texts)
    if not joined:
        return odd
    raw = np.frombuffer(joined, np.uint8)
    cls = _class_of(raw)
    found = np.flatnonzero((cls == BAD) | (raw == 0))
    if len(found):
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        for k in np.unique(np.searchsorted(ends, found, side="right")).tolist():
            odd[k] = True
    if marker in joined:
        odd = [o or marker in t for o, t in zip(odd, texts)]
    return odd


def gpt2_starts(raw: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Unit starts of the byte-level pattern: contractions, runs of letters, numbers or others with one space
    before them, and white space."""
    start = _changes(raw, cls)
    after = np.flatnonzero((cls[:-1] == WS) & (cls[1:] > WS)) + 1
    before = after - 1
    wide = raw[before] >= 0x80  # a two-byte space
    start[np.where(wide, before - 1, before)] = True
    start[after[raw[before] == 32]] = False
    _contractions(start, raw, cls, held_by_space=True)
    return start


def word_starts(raw: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Unit starts of the lower-case word pattern: contractions, runs of letters, single numbers, runs of others."""
    start = _changes(raw, cls)
    start |= (cls == NUMBER) & ((raw < 0x80) | (raw >= 0xC0))
    _contractions(start, raw, cls, held_by_space=False)
    return start


def piece_starts(raw: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Starts before runs of spaces, and before line ends: no piece of the model crosses these."""
    space = raw == 32
    start = cls == SEP
    start[0] = True
    start[1:] |= (space[1:] & ~space[:-1]) | (raw[1:] == 10) | (cls[:-1] == SEP)
    return start


def _changes(raw: np.ndarray, cls: np.ndarray) -> np.ndarray:
    start = np.ones(len(cls), bool)
    start[1:] = cls[1:] != cls[:-1]
    start |= cls == SEP
    return start


def _contractions(start: np.ndarray, raw: np.ndarray, cls: np.ndarray, held_by_space: bool) -> None:
    """'s 't 're 've 'm 'll 'd, where the apostrophe begins a match."""
    n = len(raw)
    at = np.flatnonzero(raw == 39)
    if not len(at):
        return
    before = np.maximum(at - 1, 0)
    free = (at == 0) | (cls[before] != OTHER)
    if held_by_space:
        free &= (at == 0) | (raw[before] != 32)
    at = at[free]
    one, two = raw[np.minimum(at + 1, n - 1)], raw[np.minimum(at + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < n)
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (at + 2 < n)
    for places, size in ((at[short], 2), (at[long], 3)):
        for k in range(1, size):
            start[places + k] = False
        end = places + size
        start[end[end < n]] = True


def pieces_of(text: bytes, size: int = CHUNK) -> list[bytes]:
    """A long text in pieces of about ``size`` bytes, cut where a space or line end follows a printable ASCII
    character: a unit never crosses such a place.  A stretch without any such place stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in b" \n" and 32 < text[cut - 1] < 127):
            cut += 1
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def split(texts: list[bytes], starts, drop_white: bool = False) -> Units:
    """The units of ``texts``, none of which may be odd."""
    joined = b"\x00".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return Units([], *(np.empty(0, np.int64) for _ in range(2)))
    cls = _class_of(raw)
    begin = np.flatnonzero(starts(raw, cls)).astype(np.int32)
    offsets = np.append(begin, np.int32(len(raw)))
    units = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = units.dictionary_encode()
    kind, doc = coded.indices.to_numpy(), np.cumsum(cls[begin] == SEP)
    keep = cls[begin] > (WS if drop_white else SEP)
    if not keep.all():
        kind, doc = kind[keep], doc[keep]
    return Units(coded.dictionary.to_pylist(), kind, doc)


class IdCache:
    """Ids of the units met so far in this worker, as one array with offsets; emptied when ``most`` units are held,
    so its memory has a bound whatever the corpus holds."""

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.empty(1 << 15, np.int64)
        self.size = np.empty(1 << 15, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in ``begin`` and ``size``; encodes those that are new."""
        if len(self.place) > self.most:
            self._clear()
        found = np.fromiter(map(self.place.get, words, _MINUS), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            n = len(self.place)
            ids, sizes = self.encode(new)
            while n + len(new) > len(self.size):
                self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.begin[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            found[missing] = np.arange(n, n + len(new))
            self.place.update(zip(new, range(n, n + len(new))))
        return found


class _Minus:
    """An endless supply of -1, for map()."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_MINUS = _Minus()


def expand(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``begin`` and are ``size`` long, one after another."""
    offset = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(begin - offset, size)]


def by_bytes(sizes: list[int], most: int = CHUNK):
    """Ranges of texts of about ``most`` bytes each: a run of short texts, or one long text."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield at, k
            at, held = k, 0
        held += size + 1
    if at < len(sizes):
        yield at, len(sizes)
