"""Substring dedup by hashing lines and passages.

Units are lines of at least ``LINE_WORDS`` words and passages, which are all runs of ``PASSAGE_WORDS`` words wherever their
lines begin and end.  A unit is normalised to its words: A-Z as a-z, separated by space and U+0009 to U+000D.  Digests are
grouped over all documents; the document of the smallest id (and in it the first place) keeps a unit, and every other
occurrence goes.  Every word of a repeated passage goes, so longer repeats are matched to the word at both edges.

Not all passages are grouped: hashes of ``GRAM`` words are winnowed first (the least of each passage, so equal passages
choose equal ones), and only passages around a hash that two documents chose, or one document twice, are compared.  No
repeat is lost by this.  Of documents with equal texts only that of the smallest id goes this way; all others are
repeats from end to end.  Lines and whole texts are known by 128 bits of a digest, passages by 64.

What repeats is known in word places; only the texts that lose something are cut.  Spans are code-point offsets into the
original text; a removed line's span includes the line end that goes with it.

Defined results: null and empty texts stay as they are; rows of one id rank alike, so none of them loses what only
another of them has; a row with a null id is a document of its own, ranked before all others by a hash of its text (ids
below -2 ** 62 are not told from these); equal rows get equal results; an empty table gives an empty result; texts are
processed whole, whatever their length; other columns are kept as they are by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import dropped, table, written
from quarrywell.llm.wordhash import Words, by_bytes

LINE_WORDS, PASSAGE_WORDS, GRAM = 6, 50, 16
_SPREAD = PASSAGE_WORDS - GRAM + 1  # places of a gram in a passage
_NULL_TOP = -(2**62)
LINE, PRINT, WHOLE, OWN = range(4)


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hash():
    return F.xxhash64(_text())


def _key():
    """The rank of a row."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_TOP) - _hash().bitwiseAND(F.lit(2**62 - 1)))


def _line_units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each line that is long enough."""
    start = np.flatnonzero(np.diff(w.line, prepend=-1))
    size = np.diff(np.append(start, len(w.line)))
    held = size >= LINE_WORDS
    return start[held], size[held]


def _prints(w: Words, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, and whether it was chosen at two places, of each gram that some passage of a text chooses."""
    n = len(w.hash) - PASSAGE_WORDS + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    least, width = w.grams(GRAM), 1
    while width < _SPREAD:
        step = min(width, _SPREAD - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.flatnonzero(doc[:n] == doc[PASSAGE_WORDS - 1 :])
    d, v = doc[at], least[at]
    turn = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(at) else at
    long = np.diff(np.append(turn, len(at))) > _SPREAD  # one place is not in so many passages
    d, v = d[turn], v[turn]
    order = np.lexsort((v, d))
    d, v, long = d[order], v[order], long[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.empty(0, bool)
    start = np.flatnonzero(new)
    twice = (np.diff(np.append(start, len(d))) > 1) | (np.logical_or.reduceat(long, start) if len(start) else np.empty(0, bool))
    return d[start], v[start], twice


def _again(doc: np.ndarray, *digest: np.ndarray) -> np.ndarray:
    """Whether each unit stands earlier in its own text."""
    order = np.lexsort((np.arange(len(doc)), *digest, doc))
    same = np.ones(max(len(doc) - 1, 0), bool)
    for x in (doc, *digest):
        same &= x[order][1:] == x[order][:-1]
    out = np.zeros(len(doc), bool)
    out[order[1:]] = same
    return out


def _units(docs: DataFrame) -> DataFrame:
    """key, th (a hash of the text), kind, pos, n, a, b: lines (place and number of words, digest), prints (a; n is 1 where the
    text has it twice), whole texts (n words, second hash in b), and lines that stand earlier in their own text."""
    names = ["key", "th", "kind", "pos", "n", "a", "b"]

    def run(batches):
        for batch in batches:
            for some, texts in by_bytes(batch, 3):
                w = Words(texts)
                doc = w.docs()
                start, size = _line_units(w)
                a, b = w.runs(start, start + size), w.runs(start, start + size, 1)
                d, at = doc[start], start - w.first[doc[start]]
                own = _again(d, a, b)
                p, h, twice = _prints(w, doc)
                whole, counts = np.arange(len(texts)), np.diff(w.first)
                kinds = [np.full(len(x), k, np.int8) for k, x in ((LINE, d), (OWN, d[own]), (PRINT, p), (WHOLE, whole))]
                none = np.zeros(len(p), np.int64)
                rows = np.concatenate([d, d[own], p, whole])
                key, th, other = (c.to_numpy() for c in some.columns[:3])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[rows]), pa.array(th[rows]), pa.array(np.concatenate(kinds)), pa.array(np.concatenate([at, at[own], none, 0 * whole]).astype(np.int32)),
                    pa.array(np.concatenate([size, size[own], twice, counts]).astype(np.int32)), pa.array(np.concatenate([a, a[own], h, 0 * whole])), pa.array(np.concatenate([b, b[own], none, other])),
                ], names)

    source = docs.select(_key().alias("key"), _hash().alias("th"), F.xxhash64(_text(), F.lit(8)).alias("other"), _text().alias("text"))
    return source.mapInArrow(run, "key long, th long, kind byte, pos int, n int, a long, b long")


def _passages(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """key, th, pos, hash of the passages around marked prints; hash is null where the same text has the passage before."""

    def run(batches):
        for batch in batches:
            for some, texts in by_bytes(batch, 4):
                w = Words(texts)
                grams, found = w.grams(GRAM), w.grams(PASSAGE_WORDS)
                prints, own = some.column(2), some.column(3).to_pylist()
                out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
                for k, (first, after) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    n = after - first - PASSAGE_WORDS + 1
                    if n < 1:
                        continue
                    hit = np.concatenate([[0], np.cumsum(np.isin(grams[first : after - GRAM + 1], prints[k].values.to_numpy()))])
                    at = np.flatnonzero(hit[_SPREAD:] > hit[:n])
                    mine = found[first : first + n]
                    out.append((k, at, mine[at], np.zeros(len(at), bool)))
                    if own[k]:
                        _, place, which = np.unique(mine, return_index=True, return_inverse=True)
                        at = np.flatnonzero(np.arange(n) - place[which] >= PASSAGE_WORDS)
                        out.append((k, at, mine[at], np.ones(len(at), bool)))
                if not out:
                    continue
                rows = np.repeat([k for k, *_ in out], [len(x) for _, x, *_ in out])
                at, hashes, null = (np.concatenate(x) for x in list(zip(*out))[1:])
                yield pa.RecordBatch.from_arrays([pa.array(some.column(0).to_numpy()[rows]), pa.array(some.column(1).to_numpy()[rows]), pa.array(at.astype(np.int32)), pa.array(hashes, mask=null)], ["key", "th", "pos", "hash"])

    texts = docs.select(_key().alias("key"), _hash().alias("th"), _text().alias("text"))
    return texts.join(marked, ["key", "th"]).select("key", "th", "prints", "own", "text").mapInArrow(run, "key long, th long, pos int, hash long")


def _joined_up(found: DataFrame) -> DataFrame:
    """key, th, pos, n, by: one span for passages (key, th, pos, by) that overlap or touch; by is that of the first."""

    def run(batches):
        open_ = np.empty((0, 5), np.int64)  # key, th, from, to, by of the span that may go on
        for batch in batches:
            key, th, at, by = (c.to_numpy().astype(np.int64) for c in batch.columns)
            rows = np.concatenate([open_, np.stack([key, th, at, at + PASSAGE_WORDS, by], axis=1)])
            if not len(rows):
                continue
            cut = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] > rows[:-1, 3])])
            start = np.flatnonzero(cut)
            spans = rows[start].copy()
            spans[:, 3] = rows[np.append(start[1:], len(rows)) - 1, 3]
            open_ = spans[-1:]
            yield _spans(spans[:-1])
        yield _spans(open_)

    return found.repartition("key", "th").sortWithinPartitions("key", "th", "pos", "by").mapInArrow(run, "key long, th long, pos int, n int, by long")


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array((rows[:, 3] - rows[:, 2]).astype(np.int32)), pa.array(rows[:, 4])], ["key", "th", "pos", "n", "by"])


def repeated(docs: DataFrame) -> DataFrame:
    """key, th, lines, passages: the repeated units of each text that has any, as arrays of (pos, n, by): word places and
    the key of the document that keeps them."""
    units = written(_units(docs), "units")
    # Grouping sums up inside each task first.  Written, so that the join below is one of two plain shuffles, in which
    # adaptive execution splits the partition of a digest that very many documents share.
    lines = units.where(F.col("kind") == LINE)
    first = written(lines.groupBy("a", "b").agg(F.min("key").alias("by"), F.max("key").alias("last")).where("by < last").select("a", "b", "by"), "first-lines")
    own = units.where(F.col("kind") == OWN).select("key", "th", "pos", "n", F.col("key").alias("by"))
    gone = written(lines.join(first, ["a", "b"]).where("key > by").select("key", "th", "pos", "n", "by").unionByName(own), "repeated-lines")

    whole = units.where((F.col("kind") == WHOLE) & (F.col("n") >= PASSAGE_WORDS)).select("key", "th", F.col("b").alias("other"), "n")
    copied = whole.groupBy("th", "other").agg(F.min("key").alias("by"), F.max("key").alias("last")).where("by < last").select("th", "other", "by")
    copied = written(copied, "equal-texts")
    copies = written(whole.join(copied, ["th", "other"]).where("key > by").select("key", "th", F.lit(0).alias("pos"), "n", "by").distinct(), "copies")

    prints = units.where(F.col("kind") == PRINT).select("key", "th", F.col("a").alias("print"), (F.col("n") > 0).alias("twice"))
    shared = prints.groupBy("print").agg(F.min("key").alias("by"), F.max("key").alias("last"), F.max("twice").alias("own")).where("by < last OR own").select("print")
    shared = written(shared, "shared-prints")
    marked = prints.join(shared, "print").groupBy("key", "th").agg(F.collect_set("print").alias("prints"), F.max("twice").alias("own"))
    marked = written(marked.join(copies.select("key", "th"), ["key", "th"], "left_anti"), "marked")
    dropped(units, copied, shared)
    near = written(_passages(docs, marked), "passages")
    held = near.where("hash IS NOT NULL").groupBy("hash").agg(F.min("key").alias("by"), F.max("key").alias("last")).where("by < last").select("hash", "by")
    held = written(held, "first-passages")
    again = near.join(held, "hash").where("key > by").select("key", "th", "pos", "by")
    within = near.where("hash IS NULL").select("key", "th", "pos", F.col("key").alias("by"))
    spans = written(_joined_up(again.unionByName(within)), "spans")
    dropped(near)

    unit = F.struct("pos", "n", "by")
    by_line = gone.groupBy("key", "th").agg(F.collect_set(unit).alias("lines"))
    by_span = spans.unionByName(copies).groupBy("key", "th").agg(F.collect_set(unit).alias("passages"))
    out = written(by_line.join(by_span, ["key", "th"], "full"), "repeats")
    dropped(first, gone, marked, held, spans, copies)
    return out


def _arrays(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = column[k]
    if not held.is_valid or not len(held.values):
        return (np.empty(0, np.int64),) * 3
    pos, n, by = (held.values.field(f).to_numpy().astype(np.int64) for f in range(3))
    order = np.lexsort((by, pos))  # of two keepers of one place the smaller; the text itself (by == key) is the largest
    return pos[order], n[order], by[order]


def spans_of(text: bytes, lines, passages) -> list[tuple[int, int, int, int]]:
    """(start, end, words, by) of what goes from a text, in code points, from (pos, n, by) arrays in order of pos."""
    w = Words([text])
    size = len(text)
    out: list[tuple[int, int, int, int]] = []
    goes, by = np.zeros(len(w.begin), bool), np.zeros(len(w.begin), np.int64)
    for p, n, b in zip(*(x[::-1].tolist() for x in passages)):  # of overlapping ones the first names the keeper
        goes[p : p + n], by[p : p + n] = True, b
    last = -1
    for p, n, b in zip(*(x.tolist() for x in lines)):
        if p == last:
            continue
        last, goes[p : p + n] = p, False
        start = text.rfind(b"\n", 0, int(w.begin[p])) + 1
        end = text.find(b"\n", int(w.end[p + n - 1]))
        out.append((start, size if end < 0 else end + 1, n, b))
    turn = np.flatnonzero(np.diff(np.concatenate([[0], goes, [0]]).astype(np.int8)))
    for first, after in turn.reshape(-1, 2).tolist():
        start, end = int(w.begin[first]), int(w.end[after - 1])
        if not start or text[start - 1] == 10:  # whole lines go with the line end, where only white space is left before it
            rest = text.find(b"\n", end)
            rest = size if rest < 0 else rest + 1
            end = rest if not text[end:rest].strip(b" \t\x0b\x0c\r\n") else end
        out.append((start, end, after - first, int(by[first])))
    out.sort()
    if out and not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        out = [(int(points[a]), int(points[b]), n, by_) for a, b, n, by_ in out]
    return out


def without(text: str, spans: list[tuple]) -> str:
    parts, at = [], 0
    for start, end, *_ in spans:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])


def _cut(text: bytes, lines, passages, k: int) -> list[tuple[int, int, int, int]]:
    if not lines[k].is_valid and not passages[k].is_valid:
        return []
    return spans_of(text, _arrays(lines, k), _arrays(passages, k))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, kept_doc_id of every removed span."""
    names = ["doc_id", "start", "end", "n_words", "kept_doc_id"]

    def run(batches):
        for batch in batches:
            for some, texts in by_bytes(batch, 3):
                rows = []
                for k, (doc_id, text) in enumerate(zip(some.column(0).to_pylist(), texts)):
                    rows += [(doc_id, a, b, n, None if by < _NULL_TOP else by) for a, b, n, by in _cut(text, some.column(1), some.column(2), k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), _hash().alias("th"), _text().alias("text"))
    joined = plain.join(repeated(docs), ["key", "th"]).select("doc_id", "lines", "passages", "text")
    return joined.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns, the repeated units taken out of text."""
    names = docs.columns

    def run(batches):
        at = names.index("text")
        for batch in batches:
            for some, texts in by_bytes(batch, at):
                new = some.column(at).to_pylist()
                lines, passages = some.column(len(names)), some.column(len(names) + 1)
                for k, text in enumerate(texts):
                    if spans := _cut(text, lines, passages, k):
                        new[k] = without(new[k], spans)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else some.column(k) for k in range(len(names))], names)

    found = repeated(docs).select(*(F.col(n).alias(f"qw_{n}") for n in ("key", "th", "lines", "passages")))
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumns({"qw_key": _key(), "qw_th": _hash()})
    joined = rows.join(found, ["qw_key", "qw_th"], "left").select(*(F.col(f"`{n}`") for n in names), "qw_lines", "qw_passages")
    return joined.mapInArrow(run, joined.select(*(F.col(f"`{n}`") for n in names)).schema)


def op8_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
