"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the whole corpus are counted; the most frequent ones, with their ids, are compiled into one
automaton whose states share prefixes and suffixes.  Outputs on its transitions add up to a word's number, which
points to its ids.  The file is shipped to every executor once and memory-mapped there, so the workers of a machine
share its pages.  The distinct words of a chunk walk the automaton together, one byte a step; words that it does
not hold are merged exactly, so the lexicon's size changes speed, never results.  Words of all scripts go this way; only
the splitting differs (class tables, or the library's pattern), and added tokens inside a text keep their ids.

Defined results: null and empty texts have no ids and decode to the empty text; equal rows are all kept; a null id
is kept; an empty table gives an empty lexicon and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm import wordsplit as ws
from quarrywell.llm.common import shared_dir, table, text_runs, written
from quarrywell.llm.encoders import BatchEncoder, path_of
from quarrywell.llm.merging import WordMerger, byte_symbols

TOKENIZER, WORDS = "byte_bpe_50k.json", 65_536
_MAGIC = b"QWLEX001"


class Automaton:
    """A minimal acyclic transducer from words to their numbers in sorted order, in arrays.

    Transition k of the sorted array ``keys`` (state * 256 + byte) leads to state ``to[k]`` and adds ``out[k]``.
    ``final``: whether a word ends in a state.
    """

    def __init__(self, keys, to, out, final, ids_at, ids):
        self.keys, self.to, self.out, self.final, self.ids_at, self.ids = keys, to, out, final, ids_at, ids

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> Automaton:
        """``words`` sorted and distinct.  Suffixes are shared as soon as no later word can change them."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...)) of each finished state
        path: list[list] = [[False, []]]  # the unfinished states of the last word: final, transitions

        def finish(down_to: int) -> None:
            while len(path) > down_to:
                final, edges = path.pop()
                state = (final, tuple(edges))
                if state not in known:
                    known[state] = len(states)
                    states.append(state)
                path[-1][1][-1] = (path[-1][1][-1][0], known[state])

        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            finish(shared + 1)
            for b in word[shared:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        finish(1)
        root = (path[0][0], tuple(path[0][1]))
        states.append(root)
        ends = [0] * len(states)  # words that end in or below a state; targets are finished before their sources
        keys, to, out = [], [], []
        for n, (final, edges) in enumerate(states):
            total = int(final)
            for byte, target in edges:
                keys.append(n * 256 + byte)
                to.append(target)
                out.append(total)
                total += ends[target]
            ends[n] = total
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return Automaton(
            np.array(keys, np.int64), np.array(to, np.int32), np.array(out, np.int32), np.array([s[0] for s in states], np.uint8),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for x in ids for i in x], np.uint32),
        )

    def tobytes(self) -> bytes:
        arrays = [self.keys, self.ids_at, self.to, self.out, self.ids, self.final]
        head = np.array([len(a) for a in arrays], np.int64).tobytes()
        return _MAGIC + head + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def mapped(path: str) -> Automaton:
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        sizes, at, got = raw[8:56].view(np.int64), 56, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int64, np.int32, np.int32, np.uint32, np.uint8)):
            end = at + n * np.dtype(kind).itemsize
            got.append(raw[at:end].view(kind))
            at = end
        keys, ids_at, to, out, ids, final = got
        return Automaton(keys, to, out, final, ids_at, ids)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those it does not hold."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        result = np.full(n, -1, np.int64)
        if not len(self.keys) or not n:
            return result
        whole = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        live = np.flatnonzero(size)
        state, total, step = np.full(len(live), len(self.final) - 1, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + whole[begin[live] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            live, k = live[ok], k[ok]
            state, total = self.to[k].astype(np.int64), total[ok] + self.out[k]
            step += 1
            end = size[live] == step
            done = end & (self.final[state] == 1)
            result[live[done]] = total[done]
            live, state, total = live[~end], state[~end], total[~end]
        return result


class LexiconEncoder:
    """Ids of words: from the automaton if it holds them, else merged."""

    def __init__(self, tokenizer: str, automaton: Automaton):
        self.automaton, self.merger = automaton, WordMerger(path_of(tokenizer))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.automaton.numbers(words)
        held = np.flatnonzero(found >= 0)
        rest = np.flatnonzero(found < 0)
        merged, counts = self.merger.merge([words[k] for k in rest.tolist()])
        size, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[rest], at[rest] = counts, np.cumsum(counts) - counts
        at[held] = len(merged) + self.automaton.ids_at[found[held]]
        size[held] = self.automaton.ids_at[found[held] + 1] - self.automaton.ids_at[found[held]]
        return ws.expand(np.concatenate([merged, self.automaton.ids]), at, size), size


def word_counts(docs: DataFrame, tokenizer: str = TOKENIZER, most: int = 200_000) -> DataFrame:
    """word, n over the whole corpus; counted per task first, in a table emptied when it holds ``most`` words."""

    def run(batches):
        enc = BatchEncoder(tokenizer, encode=lambda w: w)
        held: dict[bytes, int] = {}

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for part in text_runs(batch, 0):
                data = [(t or "").encode() for t in part.column(0).to_pylist()]
                odd = ws.odd_texts(data)
                units = ws.split([p for t, o in zip(data, odd) if not o for p in ws.pieces_of(t)], enc.starts)
                for w, n in zip(units.words, np.bincount(units.kind, minlength=len(units.words)).tolist()):
                    held[w] = held.get(w, 0) + n
                for text in (t for t, o in zip(data, odd) if o):
                    for w in enc.odd_units(text.decode()):
                        if isinstance(w, bytes):
                            held[w] = held.get(w, 0) + 1
                if len(held) > most:
                    yield out()
        yield out()

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str = TOKENIZER, words: int = WORDS) -> Automaton:
    """The most frequent words of all of ``docs``, at most ``words``, with their ids.

    A histogram of the counts, in steps of a sixteenth of a doubling, gives the count from which on words are taken,
    so no more than ``words`` rows ever leave the executors."""
    counted = written(word_counts(docs, tokenizer).where("n > 1 AND length(word) > 0 AND word <> X'00'"), "word-counts")
    step = F.floor(F.log2("n") * 16).cast("int")
    taken, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        taken += r["words"]
        if taken > words:
            break
        least = r["n"]
    top = [] if least is None else counted.where(F.col("n") >= least).select("word").toPandas()["word"]
    chosen = sorted({bytes(w) for w in top})
    flat, counts = WordMerger(path_of(tokenizer)).merge(chosen)
    return Automaton.build(chosen, [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if chosen else [])


def ship(spark: SparkSession, automaton: Automaton) -> str:
    """Write the lexicon once into the shared folder; Spark brings the file to each executor.  Its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/quarrywell/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(automaton.tobytes()))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


@lru_cache(2)
def _opened(tokenizer: str, path: str) -> tuple[BatchEncoder, Decoder]:
    return BatchEncoder(tokenizer, encode=LexiconEncoder(tokenizer, Automaton.mapped(path)).encode), Decoder(tokenizer)


class Decoder:
    """Texts from ids: the tokens' bytes one after another, as UTF-8."""

    def __init__(self, tokenizer: str):
        with open(path_of(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: k for k, s in enumerate(byte_symbols())}
        top = max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes_of = [b""] * (top + 1)
        for token, k in spec["model"]["vocab"].items():
            self.bytes_of[k] = bytes(byte_of[c] for c in token)
        for a in spec["added_tokens"]:
            self.bytes_of[a["id"]] = a["content"].encode()
        self.digits = [str(k) for k in range(top + 1)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()


def encode_decode(docs: DataFrame, lexicon: str, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: also ids and decoded."""

    def run(batches):
        from pyspark import SparkFiles

        enc, dec = _opened(tokenizer, SparkFiles.get(lexicon))
        sha = hashlib.sha256
        for batch in batches:
            for some in text_runs(batch, 1):
                ids, counts = enc.encode(some.column(1).to_pylist())
                lists = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
                texts = [dec.decode(x) for x in lists]
                out = [some.column(0), pa.array(counts, pa.int64()), pa.array([sha(",".join(map(dec.digits.__getitem__, x)).encode()).hexdigest() for x in lists]), pa.array([sha(t).hexdigest() for t in texts])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(lists, pa.list_(pa.int32())), pa.array([t.decode() for t in texts])], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))


def op2_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, ship(spark, build_lexicon(docs)))
