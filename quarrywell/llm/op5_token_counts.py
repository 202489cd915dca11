"""Token counts: Arrow batches in, lengths only out.

Each Arrow batch is cut into runs of about equal bytes, and long texts at places that no token crosses (before a
run of spaces or a line end, see ``wordsplit.piece_starts``).  A sentencepiece model whose pieces hold the space
mark only at their front, with an identity normaliser, gives a unit the same pieces alone as in its text, so
distinct units are counted once each.  A text outside the class tables goes to the library in pieces of about
``PIECE`` bytes, cut before a run of spaces or a line end, which is as safe in any script; only a text that holds the space
mark itself or a null character goes whole, as does any text where the model's pieces may cross units.

Defined results: null and empty texts have no tokens and no bytes; equal rows are all counted; a null id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm import wordsplit as ws
from quarrywell.llm.common import table, text_runs
from quarrywell.llm.encoders import encoder, path_of

MODEL, LIMIT = "piece_bpe_32k.model", 4096
MARK = "▁"
PIECE = 1 << 16


class PieceCounter:
    def __init__(self, name: str, most: int = 600_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path_of(name))
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path_of(name), "rb") as f:
            spec.ParseFromString(f.read())
        norm, pieces = spec.normalizer_spec, [p.piece for p in spec.pieces]
        self.by_units = (
            norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and all(p.strip(MARK) == "" or MARK not in p.lstrip(MARK) for p in pieces)
            and not any("\n" in p for p in pieces) and not any(p.type == 4 for p in spec.pieces)
        )
        self.most = most
        self.known: dict[bytes, int] = {}

    def _new(self, units: list[bytes]) -> None:
        """A unit's own count: the model puts a space mark in front of what it is given.  So a unit's first
        space is left out, and one that begins with a line end, which joins nothing, counts one less."""
        if len(self.known) > self.most:
            self.known.clear()
        bare = [(u[1:] if u[:1] == b" " else u).decode() for u in units]
        for u, ids in zip(units, self.lib.encode(bare, num_threads=1)):
            self.known[u] = len(ids) - (u[:1] == b"\n") if u != b" " else 1  # a lone mark; the library gives nothing for ""

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        data = [(t or "").encode() for t in texts]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out = np.zeros(len(data), np.int64)
        for a, b in ws.by_bytes(size.tolist()):
            part = data[a:b]
            odd = ws.odd_texts(part, marker=MARK.encode()) if self.by_units else [True] * len(part)
            whole = [k for k, o in enumerate(odd) if o]
            if whole:
                out[[a + k for k in whole]] = self._by_library([part[k] for k in whole])
            run = [k for k, o in enumerate(odd) if not o and part[k]]
            if not run:
                continue
            if len(run) == 1:
                out[a + run[0]] = sum(int(self._units([p], k == 0)[0]) for k, p in enumerate(ws.pieces_of(part[run[0]])))
            else:
                out[[a + k for k in run]] = self._units([part[k] for k in run], True)
        return size, out

    def _by_library(self, data: list[bytes]) -> list[int]:
        """Of texts that no class table tells the units of: long ones in pieces."""
        out = [0] * len(data)
        long = {k for k, t in enumerate(data) if self.by_units and len(t) > PIECE and MARK.encode() not in t and b"\0" not in t}
        short = [k for k in range(len(data)) if k not in long]
        for k, ids in zip(short, self.lib.encode([data[k].decode() for k in short], num_threads=1)):
            out[k] = len(ids)
        for k in long:
            for piece in cut(b" " + data[k]):
                out[k] += self._count_of(piece)
        return out

    def _count_of(self, unit: bytes) -> int:
        """As in ``_new``, of one unit or several."""
        if unit == b" ":
            return 1
        return len(self.lib.encode((unit[1:] if unit[:1] == b" " else unit).decode())) - (unit[:1] == b"\n")

    def _units(self, data: list[bytes], at_start: bool) -> np.ndarray:
        """At the start of a text the library adds a space mark: the text then begins as if with a space."""
        if at_start:
            data = [b" " + t for t in data]
        units = ws.split(data, ws.piece_starts)
        get = self.known.get
        new = [w for w in units.words if w not in self.known]
        if new:
            self._new(new)
            if len(new) < len(units.words):
                lost = [w for w in units.words if w not in self.known]
                if lost:
                    self._new(lost)
        each = np.fromiter(map(get, units.words), np.int64, len(units.words))
        return np.bincount(units.doc, weights=each[units.kind], minlength=len(data)).astype(np.int64)


_CUT = re.compile(rb"\n|(?<! ) ")


def cut(text: bytes, size: int | None = None):
    """Pieces of ``size`` bytes or a little more; each but the first begins with a line end or a run of spaces."""
    at, size = 0, size or PIECE
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_counters: dict[str, object] = {}


def lengths(name: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    if name.endswith(".json"):
        ids, counts = encoder(name).encode(texts)
        return np.array([len((t or "").encode()) for t in texts], np.int64), counts
    if name not in _counters:
        _counters[name] = PieceCounter(name)
    return _counters[name].count(texts)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size, count = map(np.concatenate, zip(*(lengths(model, some.column(1).to_pylist()) for some in text_runs(batch, 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(count > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
