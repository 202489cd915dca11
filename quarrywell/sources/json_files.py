"""Memories as JSON: lines or one array, out and in."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.schema import ACTIVE, RECORD, SOURCES, STATES, USER_STATED
from quarrywell.sources import folders

EXPORTED = ["memory_id", "user_id", "content", "embedding", "score", "created_at", "last_accessed_at", "source", "importance", "lifecycle_state", "metadata", "embedding_dim", "tags"]
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
_FILE = "memory_id string, user_id string, content string, embedding array<float>, score double, created_at string, last_accessed_at string, source string, importance double, lifecycle_state string, metadata string, embedding_dim int, tags array<string>"
_PIECE = 1 << 20


def told(rows: DataFrame) -> DataFrame:
    """Times as ISO text, metadata as the object that it is (a variant: all values keep their types), a score."""
    iso = lambda c: F.date_format(c, _ISO)
    return rows.withColumns({"score": F.lit(0.0), "created_at": iso("created_at"), "last_accessed_at": iso("last_accessed_at"), "metadata": F.parse_json(F.coalesce("metadata", F.lit("{}")))})


def exported(rows: DataFrame) -> DataFrame:
    """The 13 fields."""
    return told(rows).select(EXPORTED)


def write_lines(rows: DataFrame, path: str) -> int:
    """A file of lines for each partition; the number of rows."""
    exported(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def write_array(rows: DataFrame, path: str) -> int:
    """One file with one array, in store order; the number of rows.

    Rows are sorted into ranges and written as text by all tasks; the sizes of these parts, summed up, are the places of the parts in
    the file, and they are put there side by side (see ``assembled``).  What was at path stays until the new file is whole."""
    spark, parts = rows.sparkSession, f"{path}.{uuid.uuid4().hex}.parts"
    first = rows.agg(F.min(F.struct("seq", "memory_id")).alias("first")).first()["first"]
    line = F.to_json(F.struct(*EXPORTED), {"ignoreNullFields": "false"})
    head = F.lit(False) if first is None else F.col("seq").eqNullSafe(F.lit(first["seq"])) & (F.col("memory_id") == first["memory_id"])
    told(rows.orderBy("seq", "memory_id")).select(F.concat(F.when(head, "").otherwise(","), line)).write.text(parts)
    try:
        n = spark.read.text(parts).count()
        temp = f"{path}.{uuid.uuid4().hex}.part"
        assembled(spark, parts, temp, b"[\n", b"]\n")
        folders.put_over(spark, temp, path)
    finally:
        folders.remove(spark, parts)
    return n


def assembled(spark: SparkSession, parts: str, path: str, head: bytes, tail: bytes) -> None:
    """The files of a folder, by name, as one file between head and tail.

    In a shared POSIX folder (``file:``) each part is written at its own place by a task of its own.  Elsewhere the file
    system joins the files itself where it can (``concat``), and where it can't, one stream copies them in pieces."""
    fs, folder = folders.at(spark, parts)
    files = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    if fs.getUri().getScheme() == "file":
        at, places = len(head), []
        for name, size in files:
            places.append((name.removeprefix("file:"), at))
            at += size
        target = folders.at(spark, path)[1].toUri().getPath()
        with open(target, "wb") as f:
            f.write(head)
            f.seek(at)
            f.write(tail)

        def put(batches):
            for b in batches:
                for name, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    with open(name, "rb") as source, open(target, "r+b") as f:
                        f.seek(place)
                        while piece := source.read(_PIECE):
                            f.write(piece)
                yield pa.RecordBatch.from_arrays([b.column(1)], ["place"])

        if places:
            spark.createDataFrame(places, "name string, place long").repartition(len(places)).mapInArrow(put, "place long").write.format("noop").mode("overwrite").save()
        return
    jvm = spark.sparkContext._jvm
    paths = [folders.at(spark, name)[1] for name, _ in files]
    out = folders.at(spark, path)[1]
    ends = [folders.at(spark, f"{parts}/{n}")[1] for n in ("0-head", "9-tail")]
    for p, text in zip(ends, (head, tail)):
        stream = fs.create(p, True)
        stream.write(bytearray(text))
        stream.close()
    every = [ends[0], *paths, ends[1]]
    try:
        fs.rename(every[0], out)
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(every) - 1)
        for k, p in enumerate(every[1:]):
            rest[k] = p
        fs.concat(out, rest)
    except Exception as e:
        if "UnsupportedOperation" not in f"{type(e).__name__} {e}":
            raise
        stream = fs.create(out, True)
        try:
            stream.write(bytearray(head))
            for p in every[1:]:
                source = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, _PIECE, False)
                source.close()
        finally:
            stream.close()


def _scanned(text: bytes, inside: int, depth: int):
    """Of a piece that begins inside a string or not, at a depth: the places of its brackets and braces outside strings, the depth before
    each, and state and depth after it.  A piece begins after a brace, so no backslash before it reaches into it."""
    raw = np.frombuffer(text, np.uint8)
    quotes = raw == 34
    slashes = np.flatnonzero(raw == 92)
    if len(slashes):
        first = np.r_[True, np.diff(slashes) > 1]
        run = np.cumsum(first) - 1
        length = np.bincount(run)
        after = slashes[first] + length
        odd = after[(length % 2 == 1) & (after < len(raw))]
        quotes[odd] = False  # escaped
    within = (np.cumsum(quotes) - quotes + inside) % 2 == 1
    step = np.zeros(len(raw), np.int64)
    step[((raw == 123) | (raw == 91)) & ~within] = 1
    step[((raw == 125) | (raw == 93)) & ~within] = -1
    at = np.flatnonzero(step)
    change = step[at]
    before = depth + np.cumsum(change) - change
    return raw, at, change, before, (inside + int(quotes.sum())) % 2, depth + int(change.sum())


def _pieces(batches):
    """Runs of chunks of one range of a file: file, start, text (each chunk with the brace that ended it)."""
    for b in batches:
        names, starts, values = (c.to_pylist() for c in b.columns)
        k = 0
        while k < len(names):
            e = k
            while e < len(names) and names[e] == names[k] and starts[e] == starts[k]:
                e += 1
            yield names[k], starts[k], "".join(v + "}" for v in values[k:e]).encode()
            k = e


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """place, json: the objects of the arrays in the files, read by ranges of bytes in parallel.

    The text is cut after closing braces, which Spark's reader does for any range.  Whether a range begins inside a string, and how deep,
    isn't known to it; so a first pass tells for both cases what it does to state and depth, and how many objects of the array
    it ends at each depth.  These summaries, one short row a range, are joined in the files' order.  A second pass then
    knows where it is: objects that lie in one range come out at once, and only the fragments of those that cross ranges are
    grouped and put together."""
    chunks = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def summed(batches):
        now, out = None, {}
        for name, start, text in _pieces(batches):
            cases = out.setdefault((name, start), [[0, 0, {}], [1, 0, {}]])
            for case in cases:
                raw, at, change, before, case[0], case[1] = _scanned(text, case[0], case[1])
                ends = before[(change < 0) & (raw[at] == 125)]
                for level, n in zip(*(x.tolist() for x in np.unique(ends, return_counts=True))):
                    case[2][level] = case[2].get(level, 0) + n
        now = [(*key, *(json.dumps(c) for c in cases)) for key, cases in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in now], pa.string()), pa.array([r[1] for r in now], pa.int64()), pa.array([r[2] for r in now], pa.string()), pa.array([r[3] for r in now], pa.string())], ["file", "start", "out", "within"])

    ranges = chunks.mapInArrow(summed, "file string, start long, out string, within string").collect()  # one short row for each range of a file
    begins, name, inside, depth, n = {}, None, 0, 0, 0
    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        if r["file"] != name:
            name, inside, depth = r["file"], 0, 0
        begins[name, r["start"]] = inside, depth, n
        after, change, ends = json.loads(r["within"] if inside else r["out"])
        n += ends.get(str(2 - depth), 0)
        inside, depth = after, depth + change

    def told(batches):
        held, key, inside, depth, n, whole = [], None, 0, 0, 0, True
        rows: list[tuple] = []

        def close():
            if held:
                rows.append((n, key[1], False, b"".join(held).decode()))

        for name, start, text in _pieces(batches):
            if (name, start) != key:
                close()
                key, held = (name, start), []
                inside, depth, n = begins[key]
                whole = not (inside or depth > 1)
            open_ = inside or depth > 1
            raw, at, change, before, inside, depth = _scanned(text, inside, depth)
            starts = at[(change > 0) & (before == 1) & (raw[at] == 123)].tolist()
            ends = at[(change < 0) & (before == 2) & (raw[at] == 125)].tolist()
            where = 0 if open_ else None
            marks = sorted([(p, 0) for p in starts] + [(p + 1, 1) for p in ends])
            for p, end in marks:
                if not end:
                    where = p
                elif where is not None:
                    rows.append((n, key[1], whole, b"".join([*held, text[where:p]]).decode()))
                    held, where, whole, n = [], None, True, n + 1
            if where is not None:
                held.append(text[where:])
            if rows:
                yield _told(rows)
                rows.clear()
        close()
        if rows:
            yield _told(rows)

    found = chunks.mapInArrow(told, "place long, start long, whole boolean, json string")
    parts = found.where("NOT whole").groupBy("place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "json"))), lambda x: x["json"]), "").alias("json"))
    return found.where("whole").select("place", "json").unionAll(parts)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    place, start, whole, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(start, pa.int64()), pa.array(whole), pa.array(text, pa.string())], ["place", "start", "whole", "json"])


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with a bracket; looks at no more than stands before the first brace."""
    head = spark.read.option("lineSep", "{").text(path).where("_metadata.file_block_start = 0").limit(1).collect()
    return bool(head) and head[0][0].lstrip("\ufeff \t\r\n").startswith("[")


def imported(spark: SparkSession, path: str, now=None) -> DataFrame:
    """Records of a file with defaults filled in; the first of each memory_id; bad ones raise."""
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    if is_array(spark, path):
        rows = array_objects(spark, path).select(F.from_json("json", _FILE).alias("r"), F.col("place").alias("seq")).select("r.*", "seq")
    else:
        rows = spark.read.schema(_FILE).json(path).withColumn("seq", F.monotonically_increasing_id())
    need = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("memory_id", "user_id", "content")))
    known = lambda c, values, default: F.when(F.coalesce(c, F.lit(default)).isin(list(values)), F.coalesce(c, F.lit(default))).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.col(c))))
    time = lambda c: F.when(F.coalesce(c, F.lit("")) == "", stamp).otherwise(F.to_timestamp(c))
    rows = rows.withColumns({
        "memory_id": F.when(need, F.raise_error(F.lit("memory_id, user_id and content are mandatory"))).otherwise(F.col("memory_id")),
        "created_at": time("created_at"), "last_accessed_at": time("last_accessed_at"),
        "source": known("source", SOURCES, USER_STATED), "lifecycle_state": known("lifecycle_state", STATES, ACTIVE),
        "importance": F.coalesce("importance", F.lit(0.5)), "metadata": F.coalesce("metadata", F.lit("{}")), "tags": F.coalesce("tags", F.array().cast("array<string>")),
    })
    first = rows.groupBy("memory_id").agg(F.min_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    return first.select([f.name for f in RECORD.fields])
