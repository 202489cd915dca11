"""The memory table as a data source of Spark: ``spark.read.format("memories").load(path)``, batch and stream, and appends.

``register`` makes it known, and lets filters reach it.  A batch read has a partition for each bucket of users, large buckets in
several by a hash of the id; equality on ``user_id`` or ``memory_id`` and ``IN`` on users are pushed: buckets, row groups and rows
that can't match are not read.  A task first reads ids and versions of its bucket, then the rows that are the last of their ids.

A stream read gives the rows that each write added, in order of the writes; its offset is the number of the last write.  A stream that
reads slower than the table is compacted finds the writes' rows in what they were compacted into.

Appended rows are written by tasks into ``inbox/<run>``; each task tells its file in its commit message, and one small manifest of these
makes the run count.  ``take_in`` stores what has come in, in order, through the table's own write; files of runs that failed
have no manifest and go then.

Files are opened by pyarrow in the tasks, so the path must be one that it knows (a local or shared folder, HDFS, an object store).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from quarrywell.schema import RECORD
from quarrywell.sources import folders
from quarrywell.sources.table import BUCKETS

#: Rows of a bucket for each task that reads it.
SLICE = 1_000_000
_ROWS = [f.name for f in RECORD.fields]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+]*:", path) else f"file://{path}")


def _names(path: str) -> list[tuple[str, bool]]:
    from pyarrow import fs

    system, root = _fs(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((x.base_name, x.type == fs.FileType.Directory) for x in found)


def _text(path: str) -> str:
    system, p = _fs(path)
    with system.open_input_stream(p) as f:
        return f.read().decode()


def murmur(text: str, seed: int = 42) -> int:
    """Spark's ``hash`` of a string: MurmurHash3 of 32 bits, each byte after the last whole word mixed in as a word of its own."""
    data, top = text.encode(), 0xFFFFFFFF
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & top

    def mixed(h, k):
        k = turn(k * 0xCC9E2D51 & top, 15) * 0x1B873593 & top
        return (turn(h ^ k, 13) * 5 + 0xE6546B64) & top

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mixed(h, (b - 256 if b > 127 else b) & top)
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * times & top
    return h - (1 << 32) if h >> 31 else h


def _state(path: str) -> dict:
    names = [n for n, _ in _names(f"{path}/state") if n.endswith(".json")]
    if names:
        return json.loads(_text(f"{path}/state/{names[-1]}"))
    writes = sorted(int(n.removeprefix("write=")) for n, folder in _names(f"{path}/log") if folder and n.startswith("write="))
    return {"writes": writes, "since": {}, "buckets": BUCKETS}


def _files(path: str, state: dict, bucket: int | None, after: int = -1) -> dict[int, list[str]]:
    """The Parquet files of each bucket that count, of writes after ``after``."""
    out: dict[int, list[str]] = {}
    for w in state["writes"]:
        if w <= after:
            continue
        for name, _ in _names(f"{path}/log/write={w}"):
            b = int(name.removeprefix("user_bucket=")) if name.startswith("user_bucket=") else None
            if b is not None and (bucket is None or b == bucket) and w >= state["since"].get(str(b), 0):
                out.setdefault(b, []).extend(f"{path}/log/write={w}/{name}/{f}" for f, folder in _names(f"{path}/log/write={w}/{name}") if f.endswith(".parquet"))
    return out


@dataclass
class _Slice(InputPartition):
    files: list
    part: int
    parts: int

    def __init__(self, files, part=0, parts=1):
        self.files, self.part, self.parts = files, part, parts


def _tables(files: list[str], columns: list[str], wanted):
    """Batches of the files, of the columns that they have, filtered where their statistics allow."""
    import pyarrow.dataset as ds

    for name in files:
        system, p = _fs(name)
        data = ds.dataset(p, filesystem=system, format="parquet")
        there = [c for c in columns if c in data.schema.names]
        yield from data.to_batches(columns=there, filter=wanted)


def _plain(batch, columns):
    """The columns as the record has them; those that a file of an older version lacks are null, its tags empty."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    out = []
    for c in columns:
        kind = schema.field(c).type
        col = batch.column(c).cast(kind) if c in batch.schema.names else pa.nulls(batch.num_rows, kind)
        out.append(pa.array([x if x is not None else [] for x in col.to_pylist()], kind) if c == "tags" and col.null_count else col)
    return pa.RecordBatch.from_arrays(out, schema=pa.schema([schema.field(c) for c in columns]))


class MemoryReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.users, self.ids = path, None, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("user_id",):
                self.users = ({f.value} if self.users is None else self.users & {f.value})
            elif isinstance(f, In) and f.attribute == ("user_id",):
                self.users = set(f.value) if self.users is None else self.users & set(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("memory_id",):
                self.ids = ({f.value} if self.ids is None else self.ids & {f.value})
            else:
                yield f

    def partitions(self):
        state = _state(self.path)
        buckets = [None] if self.users is None else sorted({murmur(u) % state["buckets"] for u in self.users if u is not None})
        out = []
        for b in buckets:
            for files in _files(self.path, state, b).values():
                out += self._sliced(files)
        return out or [_Slice([])]

    def _sliced(self, files):
        import pyarrow.parquet as pq

        rows = 0
        for name in files:
            system, p = _fs(name)
            rows += pq.read_metadata(p, filesystem=system).num_rows
        parts = max(1, -(-rows // SLICE))
        return [_Slice(files, k, parts) for k in range(parts)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        by_id = None if self.ids is None else pc.field("memory_id").isin(list(self.ids))
        last: dict[str, tuple[int, bool]] = {}
        mine = lambda i: partition.parts == 1 or murmur(i) % partition.parts == partition.part
        for b in _tables(partition.files, ["memory_id", "version", "moved"], by_id):
            moved = b.column("moved").fill_null(False).to_pylist() if "moved" in b.schema.names else [False] * b.num_rows
            for i, v, m in zip(b.column("memory_id").to_pylist(), _versions(b), moved):
                if mine(i):
                    last[i] = max(last.get(i, (-1, False)), (v, not m))
        wanted, users = by_id, self.users
        if users is not None:
            theirs = pc.field("user_id").isin([u for u in users if u is not None])
            wanted = theirs if wanted is None else wanted & theirs
        for b in _tables(partition.files, [*_ROWS, "version", "moved"], wanted):
            moved = b.column("moved").fill_null(False).to_pylist() if "moved" in b.schema.names else [False] * b.num_rows
            keep = [not m and last.get(i) == (v, True) for i, v, m in zip(b.column("memory_id").to_pylist(), _versions(b), moved)]
            if any(keep):
                yield _plain(b.filter(pa.array(np.array(keep, bool))), _ROWS)


def _versions(batch):
    return [x or 0 for x in batch.column("version").to_pylist()] if "version" in batch.schema.names else [0] * batch.num_rows


class MemoryStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"write": 0}

    def latestOffset(self):
        return {"write": max([0, *_state(self.path)["writes"]])}

    def partitions(self, start, end):
        state = _state(self.path)
        found = _files(self.path, state | {"writes": [w for w in state["writes"] if start["write"] < w]}, None)
        out = []
        for files in found.values():
            part = _Slice(files)
            part.after, part.upto = start["write"], end["write"]
            out.append(part)
        return out or [_Slice([])]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        for b in _tables(partition.files, [*_ROWS, "version", "moved"], None):
            moved = b.column("moved").fill_null(False).to_pylist() if "moved" in b.schema.names else [False] * b.num_rows
            keep = np.array([partition.after < v <= partition.upto and not m for v, m in zip(_versions(b), moved)], bool)
            if keep.any():
                yield _plain(b.filter(pa.array(keep)), _ROWS)


@dataclass
class _Told(WriterCommitMessage):
    name: str
    rows: int


class MemoryWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, n, at = to_arrow_schema(RECORD), 0, TaskContext.get()
        name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.parquet"
        system, root = _fs(f"{self.path}/inbox/{self.run}")
        system.create_dir(root, recursive=True)
        writer, held = pq.ParquetWriter(f"{root}/{name}", schema, filesystem=system), []

        def out():
            writer.write_batch(pa.RecordBatch.from_pylist(held, schema=schema))
            held.clear()

        with writer:
            for row in iterator:
                held.append(row.asDict())
                n += 1
                if len(held) >= 1024:
                    out()
            if held:
                out()
        return _Told(name, n)

    def commit(self, messages):
        system, root = _fs(f"{self.path}/inbox")
        with system.open_output_stream(f"{root}/{self.run}.part") as f:
            f.write(json.dumps({"files": [m.name for m in messages if m is not None], "rows": sum(m.rows for m in messages if m is not None)}).encode())
        system.move(f"{root}/{self.run}.part", f"{root}/{self.run}.json")

    def abort(self, messages):
        system, root = _fs(f"{self.path}/inbox/{self.run}")
        system.delete_dir_contents(root, missing_dir_ok=True)


class MemorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memories"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return MemoryReader(self.options["path"].rstrip("/"))

    def streamReader(self, schema):
        return MemoryStream(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("memories can only be appended")
        return MemoryWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    """Once in each session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemorySource)


def take_in(table) -> int:
    """Store the rows that have come in through the data source, run by run; the number of rows."""
    spark, inbox, n = table.spark, f"{table.path}/inbox", 0
    names = folders.names_in(spark, inbox)
    for manifest in [x for x in names if x.endswith(".json")]:
        run, told = manifest.removesuffix(".json"), json.loads(folders.text_of(spark, f"{inbox}/{manifest}"))
        if told["files"]:
            rows: DataFrame = spark.read.schema(RECORD).parquet(*(f"{inbox}/{run}/{f}" for f in told["files"]))
            table.store(rows)
        n += told["rows"]
        folders.remove(spark, f"{inbox}/{manifest}")
    for name in names:
        folders.remove(spark, f"{inbox}/{name}")
    return n
