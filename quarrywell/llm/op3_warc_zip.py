"""WARC records in ZIP packages, read without extraction.

An archive holds two stored members: ``archive/data.warc.gz``, WARC records compressed one by one, and
``indexes/index.cdxj``, a line for each record with its place in that member.  The reader finds the end record (and
the ZIP64 one, where there is any), parses the central directory, locates the members' data behind their local
headers, and reads single records by range.

Records with equal payloads of at least ``least_bytes`` bytes: the one with the smallest page_id is the response,
the others revisit it.

Defined results: null html is the empty payload; a null url is left out; of records with equal payloads that all have a
null page_id each is a response; rows that repeat the smallest page_id are responses too; an empty table gives no
archives and no rows; payloads of any length are held whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import fresh_path, table, written
from quarrywell.llm.files import RangeFile, put

DATE, LEAST_BYTES, ARCHIVE_BYTES = "2024-01-01T00:00:00Z", 0, 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the ZIP format: signatures, the ZIP64 extra field, sizes that stand for "see ZIP64".
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
EXTRA64, FULL32, FULL16 = 0x0001, 0xFFFFFFFF, 0xFFFF


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = True) -> list[bytes]:
    """A ZIP package of stored members, in parts to be written one after another."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= FULL32 or at >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, len(data), len(data)) if big else b""
        sizes = (FULL32, FULL32) if big else (len(data), len(data))
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", EXTRA64, 24, len(data), len(data), at) if big else b""
        directory.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(more), 0, 0, 0, 0, FULL32 if big else at) + raw + more)
        out += [head, data]
        at += len(head) + len(data)
    whole = b"".join(directory)
    n = len(members)
    tail = b""
    if zip64 or at >= FULL32 or n >= FULL16:
        tail = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(whole), at) + LOCATOR + struct.pack("<IQI", 0, at + len(whole), 1)
        tail += END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        tail = END + struct.pack("<HHHHIIH", 0, 0, n, n, len(whole), at, 0)
    return [*out, whole, tail]


class ZipReader:
    """name -> (offset of the data, size, method) of the members, from the central directory."""

    def __init__(self, file: RangeFile):
        self.file = file
        tail_at = max(0, file.size - 22 - FULL16 - 20)
        tail = file.read(tail_at, file.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
            at = tail.rfind(END, 0, at)  # the signature can also stand in the comment
        if at < 0:
            raise ValueError("no ZIP end record")
        count, size, begin = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
            (place,) = struct.unpack_from("<Q", tail, at - 12)
            record = file.read(place, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            count, size, begin = struct.unpack_from("<QQQ", record, 32)
        raw, at = file.read(begin, size), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("a central directory entry is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, unpacked, n, m, k = struct.unpack_from("<IIHHH", raw, at + 20)
            (place,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            packed, unpacked, place = self._wide(raw[at + 46 + n : at + 46 + n + m], packed, unpacked, place)
            self.members[name] = (place, packed, method)
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, packed: int, unpacked: int, place: int) -> tuple[int, int, int]:
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == EXTRA64:
                values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                unpacked = values.pop(0) if unpacked == FULL32 else unpacked
                packed = values.pop(0) if packed == FULL32 else packed
                place = values.pop(0) if place == FULL32 else place
            at += 4 + size
        return packed, unpacked, place

    def stored(self, name: str) -> tuple[int, int]:
        """Where the data of a stored member lie, and how many bytes."""
        place, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        head = self.file.read(place, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return place + 30 + n + m, size


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to a page."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, sha), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    head |= {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, sha), "X-Refers-To-Page": str(refers_to)}
    head |= {"X-Page": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_targets(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and, for revisits, refers_to.

    The smallest page_id of each digest is found with partial sums; the join of it to the pages is a plain one of two
    shuffled sides, in which adaptive execution splits the partition of a digest that many pages share."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    first = keyed.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    joined = keyed.join(first, "sha", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ZIP-packaged WARC archives under ``path``; a row for each: archive, n_records, n_bytes.

    A retried task writes new files; only those that the committed catalog names are archives of the store."""

    def run(batches):
        from pyspark import TaskContext

        part, nth, held, size, index = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal nth, held, size, index
            name = f"{path}/archive-{part:06d}-{nth:04d}-{uuid.uuid4().hex[:8]}.zip"
            total = put(name, zip_stored([(DATA, b"".join(held)), (INDEX, "".join(index).encode())]))
            made = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], ["archive", "n_records", "n_bytes"])
            nth, held, size, index = nth + 1, [], 0, []
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, refers_to = row
                raw = gzip.compress(record(page_id, url, html.encode(), refers_to), 6, mtime=0)
                index.append(json.dumps({"page": page_id, "offset": size, "length": len(raw)}) + "\n")
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
        if index:
            yield close()

    made = with_targets(pages, least_bytes).mapInArrow(run, "archive string, n_records long, n_bytes long")
    return written(made, "catalog")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(catalog: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives named in ``catalog``, read by range and held against its digest."""
    spark = catalog.sparkSession

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with RangeFile(name) as file:
                    package = ZipReader(file)
                    begin, size = package.stored(DATA)
                    lines = file.read(*package.stored(INDEX)).decode().splitlines()
                    for k in range(0, len(lines), 1000):
                        yield _rows(file, begin, size, map(json.loads, lines[k : k + 1000]), with_payload)

    few = catalog.select("archive").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    return few.mapInArrow(run, READ + (", payload binary" if with_payload else ""))


def _rows(file: RangeFile, begin: int, size: int, entries, with_payload: bool) -> pa.RecordBatch:
    rows = []
    for e in entries:
        if e["offset"] + e["length"] > size:
            raise ValueError("the index points behind its member")
        fields, block = parse(gzip.decompress(file.read(begin + e["offset"], e["length"])))
        sha, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        payload = None
        if fields["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != n or digest(payload) != sha:
                raise ValueError(f"the payload of page {e['page']} does not match its digest")
        to = fields.get("X-Refers-To-Page")
        rows.append((int(fields["X-Page"]) if fields["X-Page"] else None, n, sha, fields["WARC-Type"], None if to is None else int(to), fields.get("WARC-Target-URI"), payload))
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    kinds = kinds if with_payload else kinds[:-1]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(catalog).drop("url")
