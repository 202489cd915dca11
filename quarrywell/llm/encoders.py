"""Public tokenizers as exact batch encoders: texts are split into units, and distinct units are merged once each.  Texts
outside the class tables are split by the library's own normaliser and pattern; their units go the same way.

The vocabulary files are parameters (a name that ``public_tokenizers.path`` resolves, or a path) and are opened
on the executors, where the package is installed; nothing is copied.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from quarrywell.llm import wordsplit as ws
from quarrywell.llm.merging import WordMerger, byte_symbols

_open: dict[str, object] = {}


def path_of(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library(name: str):
    """The tokenizers library's own tokenizer for a .json file, with truncation and padding off."""
    if name not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path_of(name))
        tok.no_truncation()
        tok.no_padding()
        _open[name] = tok
    return _open[name]


class BatchEncoder:
    """Ids of whole texts, equal to the library's with add_special_tokens=False.

    Byte-level files split by the byte-level pattern, word files (lower case, white space dropped) by theirs.  A text outside
    the tables of ``wordsplit`` is split by the library, around the added tokens that it holds.
    """

    _BYTE_OF = str.maketrans({c: chr(k) for k, c in enumerate(byte_symbols())})

    def __init__(self, name: str, encode=None, most: int = 400_000):
        with open(path_of(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec.get("normalizer") is not None
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.name = name
        self.starts = ws.word_starts if self.lower else ws.gpt2_starts
        self.cache = ws.IdCache(encode or WordMerger(path_of(name)).merge, most)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's ids.  None counts as the empty text."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        data = [(t or "").encode() for t in texts]
        for a, b in ws.by_bytes(list(map(len, data))):
            ids, counts[a:b] = self._some(data[a:b])
            parts.append(ids)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), counts

    def _some(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        source = data
        if self.lower:
            data = [t.decode().lower().encode() for t in data]
        odd = ws.odd_texts(data) if not self.lower else [a or b for a, b in zip(ws.odd_texts(data), ws.odd_texts(source))]
        if not any(odd) and sum(map(len, data)) <= 2 * ws.CHUNK:
            return self._plain(data)
        out, counts, run = [], np.zeros(len(data), np.int64), []

        def flush():
            if run:
                ids, counts[run] = self._plain([data[k] for k in run])
                out.append(ids)
                run.clear()

        for k, text in enumerate(data):
            if not odd[k] and len(text) <= ws.CHUNK:
                run.append(k)
                continue
            flush()
            each = self._split_by_library(source[k].decode()) if odd[k] else [self._plain([p])[0] for p in ws.pieces_of(text)]
            out += each
            counts[k] = sum(map(len, each))
        flush()
        return np.concatenate(out), counts

    def odd_units(self, text: str):
        """The units of any text by the library's normaliser and pattern, each as its bytes; an added token as its id."""
        lib = library(self.name)
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                yield self.added[part]
            elif part:
                part = lib.normalizer.normalize_str(part) if self.lower else part
                for unit, _ in lib.pre_tokenizer.pre_tokenize_str(part):
                    yield unit.translate(self._BYTE_OF).encode("latin-1")

    def _split_by_library(self, text: str) -> list[np.ndarray]:
        units = list(self.odd_units(text))
        words = list(dict.fromkeys(u for u in units if isinstance(u, bytes)))
        place = dict(zip(words, self.cache.numbers(words).tolist()))
        out, run = [np.empty(0, np.uint32)], []
        for u in [*units, None]:
            if isinstance(u, bytes):
                run.append(place[u])
                continue
            if run:
                at = np.array(run)
                out.append(ws.expand(self.cache.flat, self.cache.begin[at], self.cache.size[at]))
                run = []
            if u is not None:
                out.append(np.array([u], np.uint32))
        return out

    def _plain(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        units = ws.split(data, self.starts, drop_white=self.lower)
        if not len(units.kind):
            return np.empty(0, np.uint32), np.zeros(len(data), np.int64)
        place = self.cache.numbers(units.words)[units.kind]
        size = self.cache.size[place]
        ids = ws.expand(self.cache.flat, self.cache.begin[place], size)
        return ids, np.bincount(units.doc, weights=size, minlength=len(data)).astype(np.int64)


_encoders: dict[str, BatchEncoder] = {}


def encoder(name: str) -> BatchEncoder:
    """One per worker process."""
    if name not in _encoders:
        _encoders[name] = BatchEncoder(name)
    return _encoders[name]
