"""Hashes of the words of many texts at once, and of runs of words, by array operations.

Words are separated by space and U+0009 to U+000D; A-Z count as a-z.  A word's hash is a polynomial in marks of its bytes, by
differences of prefix sums; that of a run of words is a polynomial in its words' hashes.  Texts are read in blocks of
``BLOCK`` bytes, cut between words, so the arrays over bytes stay small however long a text is.
"""

from __future__ import annotations

import numpy as np

from quarrywell.llm.common import text_runs

BLOCK = 1 << 18
_STEPS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_MARK = np.random.default_rng(666).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARK[65:91] = _MARK[97:123]
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(step: int, n: int) -> np.ndarray:
    """1, step, step squared, ... modulo 2 ** 64; kept from call to call."""
    if len(_powers.get(step, ())) < n:
        out = np.full(max(n, 1 << 16), step, np.uint64)
        out[0] = 1
        _powers[step] = np.cumprod(out, out=out)
    return _powers[step][:n]


def _back(step: int, n: int) -> np.ndarray:
    return _power(pow(step, -1, 1 << 64), n)


def _sums(values: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(step, len(values)), out=out[1:])
    return out


class Words:
    """The words of ``texts`` one after another: ``hash``, ``begin`` and ``end`` (byte places in the texts joined by line
    ends), ``line`` (numbers over all texts); text k has the words from ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        parts, at, n_lines = [], 0, 0
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            while end < len(raw) and not _WHITE[raw[end]]:
                end += 1
            parts.append(self._block(raw[at:end], at, n_lines))
            n_lines = parts[-1].pop()
            at = end
        self.hash, self.begin, self.end, self.line = (np.concatenate(p) if parts else np.empty(0, t) for p, t in zip(zip(*parts) if parts else [()] * 4, (np.uint64, np.int64, np.int64, np.int64)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.cumsum(sizes + 1) - (sizes + 1)
        self.first = np.append(np.searchsorted(self.begin, self.base), len(self.begin))
        self._held: dict[int, np.ndarray] = {}

    @staticmethod
    def _block(raw: np.ndarray, at: int, n_lines: int) -> list:
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = ~_WHITE[raw]
        edge = np.flatnonzero(np.diff(solid))
        begin, end = edge[::2], edge[1::2]
        step = _STEPS[0]
        total = _sums(_MARK[raw], step)
        own = mixed((total[end] - total[begin]) * _back(step, len(raw) + 1)[begin] + (end - begin).astype(np.uint64) * np.uint64(step))
        ends = np.flatnonzero(raw == 10)
        return [own, begin + at, end + at, n_lines + np.searchsorted(ends, begin), n_lines + len(ends)]

    def docs(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, start: np.ndarray, stop: np.ndarray, kind: int = 0) -> np.ndarray:
        """A hash (of two independent kinds) of each run of words [start, stop)."""
        step = _STEPS[kind]
        if kind not in self._held:
            self._held[kind] = _sums(self.hash, step)
        total = self._held[kind]
        return mixed((total[stop] - total[start]) * _back(step, len(total))[start] + (stop - start).astype(np.uint64)).view(np.int64)

    def grams(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words, those across two texts too."""
        start = np.arange(max(len(self.hash) - width + 1, 0))
        return self.runs(start, start + width)


def by_bytes(batch, column: int, most: int = BLOCK):
    """An Arrow batch in slices of about ``most`` bytes of text, each with its texts as bytes (null is empty)."""
    for some in text_runs(batch, column, most):
        yield some, [t or b"" for t in some.column(column).cast("binary").to_pylist()]
