"""Byte-pair merging of many words at once.

Words of similar byte length form a matrix of symbols.  Each round merges, in every row, the leftmost pair of the
lowest rank, which is what the sequential algorithm does next in that row, so the result is exact; the ranks
of only the two touched pairs are looked up again.  Pair ranks are in an open-addressing table.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)
WIDTHS = (1, 4, 8, 12, 20, 40, 120)  # columns of the matrices; a longer word is merged alone
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairTable:
    """rank and merged id of a pair of ids; looked up in arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.to = np.zeros(1 << bits, np.int32)
        _, first = np.unique(pairs, return_index=True)  # the first of equal pairs counts
        left = np.sort(first)
        slot = self._slot(pairs[left])
        self.probes = 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, own = np.unique(slot[free], return_index=True)
            own = free[own]
            at = slot[own]
            self.keys[at], self.rank[at], self.to[at] = pairs[left[own]], left[own], merged[left[own]]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        slot = self._slot(keys)
        at = self.keys[slot]
        rank, to = np.where(at == keys, self.rank[slot], NONE), self.to[slot]
        left = np.flatnonzero((at != keys) & (at != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            at = self.keys[slot[left]]
            hit = left[at == keys[left]]
            rank[hit], to[hit] = self.rank[slot[hit]], self.to[slot[hit]]
            left = left[(at != keys[left]) & (at != -1)]
        return rank, to


class WordMerger:
    """Ids of words by the merges of a tokenizer's .json file (byte-level symbols, perhaps a suffix at word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = vocab
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.table = PairTable(pairs, np.array([vocab[a + b] for a, b in merges], np.int32))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the words, and the number of each word's ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.frombuffer(b"".join(words) + bytes(WIDTHS[-1]), np.uint8)
        begin = np.cumsum(size) - size
        out: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(words), np.int64)
        below = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > below) & (size <= width))
            below = width
            for part in np.array_split(rows, max(1, len(rows) * width // 1_000_000)):
                if len(part):
                    n = size[part]
                    raw = whole[begin[part][:, None] + np.arange(width)]
                    ids = self.inner[raw]
                    at = np.arange(len(part)), n - 1
                    ids[at] = self.last[raw[at]]
                    ids, counts[part] = self._rounds(ids, n)
                    out.append((part, ids[np.arange(width) < counts[part][:, None]]))
        for k in np.flatnonzero(size > below).tolist():
            ids = self._long(whole[begin[k] : begin[k] + size[k]])
            counts[k] = len(ids)
            out.append((np.array([k]), ids))
        flat = np.empty(int(counts.sum()), np.uint32)
        place = np.cumsum(counts) - counts
        for part, ids in out:
            n = counts[part]
            off = np.cumsum(n) - n
            flat[np.arange(len(ids)) + np.repeat(place[part] - off, n)] = ids
        return flat, counts

    def _rounds(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged rows and their lengths; ``n``: how many symbols of each row count."""
        rows, width = ids.shape
        n = n.copy()
        if width == 1:
            return ids, n
        rank = np.full((rows, width), NONE, np.int32)
        to = np.zeros((rows, width), np.int32)
        there = np.arange(width) < (n - 1)[:, None]
        r, c = np.nonzero(there)
        rank[r, c], to[r, c] = self.table.find(ids[r, c], ids[r, c + 1])
        done_ids, live = ids.copy(), np.arange(rows)
        cols = np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            go = rank[np.arange(len(live)), at] != NONE
            if not go.all():
                done_ids[live[~go]] = ids[~go]
                live, ids, rank, to, at = live[go], ids[go], rank[go], to[go], at[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            new = to[row, at]
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            take += (row * width)[:, None]
            ids, rank, to = ids.ravel()[take], rank.ravel()[take], to.ravel()[take]
            ids[row, at] = new
            n[live] -= 1
            size = n[live]
            rank[row, size - 1] = NONE
            rank[:, -1] = NONE
            for shift in (-1, 0):
                a = at + shift
                ok = np.flatnonzero((a >= 0) & (a + 1 < size))
                if len(ok):
                    rank[ok, a[ok]], to[ok, a[ok]] = self.table.find(ids[ok, a[ok]], ids[ok, a[ok] + 1])
        return done_ids, n

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """One long word: a heap of pairs over a linked list, as rounds over a wide row would be quadratic."""
        import heapq

        ids = self.inner[raw]
        ids[-1] = self.last[raw[-1]]
        rank, to = self.table.find(ids[:-1], ids[1:])
        heap = [(r, k, ids[k], ids[k + 1], t) for k, (r, t) in enumerate(zip(rank.tolist(), to.tolist())) if r != NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt < 0 or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = made, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for p in (before[k], k):
                q = after[p] if p >= 0 else -1
                if q >= 0:
                    r, t = self.table.find(np.array([ids[p]]), np.array([ids[q]]))
                    if r[0] != NONE:
                        heapq.heappush(heap, (int(r[0]), p, ids[p], ids[q], int(t[0])))
        return np.array([i for i in ids if i >= 0], np.uint32)
