"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's ids into chunks, so equal passages give equal
chunks wherever they stand.  Layout of a store, all in Parquet:

* ``chunks``: digest (SHA-256 of the ids as little-endian unsigned 32-bit), ids (little-endian, of ``width`` bytes each: 2 if all
  are below 65,536, else 4), width; each digest once;
* ``recipes``: in ascending doc_id order, doc_id, start, n_tokens, digests and lengths of the chunks in order, and
  the Merkle root over the digests;
* ``manifest``: for each range partition of the recipes the Merkle root over its documents' roots, in order.

Reading verifies: each chunk against its digest, each recipe against its Merkle root, each partition against the
manifest.  A document's CRC-32 comes from its chunks': CRC-32 is linear, so a chunk's share of the whole is its
own CRC moved by the number of bytes behind it, and the shares of all chunks are XORed; no ids need to move.
``read_documents`` puts the ids themselves together.

Defined results: a null or empty text is its end id alone; rows with a null id come first; rows with equal ids
stand one after another, each a document of its own; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import forget, fresh_path, table, text_runs
from quarrywell.llm.encoders import encoder
from quarrywell.llm.ordering import in_id_order, partition_offsets

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
WINDOW, LEAST, MOST, BITS = 16, 64, 4096, 9  # ids; a cut where BITS bits of the hash are 0: 512 ids apart in the mean
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents, whose ids stand one after another up to ``ends``.  A chunk ends with its document,
    at the first hash cut LEAST ids or more after its beginning, or after MOST ids."""
    found = np.empty(0, np.int64)
    if len(ids) > LEAST:
        key = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
        key ^= key >> np.uint64(29)
        rolling = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolling = rolling * np.uint64(3) + key[k : len(ids) - WINDOW + 1 + k]
        rolling *= _STEP
        found = np.flatnonzero(rolling >> np.uint64(64 - BITS) == 0) + WINDOW
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    own = start[np.searchsorted(ends, found)]
    found = found[found - own >= LEAST]  # those whose window begins in an earlier document, and others that can't be used
    at = np.searchsorted(found, ends, "right").tolist()
    found, out, k = found.tolist(), [], 0
    for last, end, upto in zip(start.tolist(), ends.tolist(), at):
        for c in [*found[k:upto], end]:
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c > last and (c - last >= LEAST or c == end):
                out.append(c)
                last = c
        k = upto
    return np.array(out, np.int64)


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def narrow(ids: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The stored form of each chunk [edges[k], edges[k + 1]) and its width."""
    width = np.where(np.maximum.reduceat(ids, edges[:-1]) < 65_536, 2, 4) if len(edges) > 1 else np.empty(0, np.int64)
    if (width == 2).all():
        return pa.BinaryArray.from_buffers(pa.binary(), len(width), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))]), width
    return pa.array([ids[a:b].astype(f"<u{w}").tobytes() for a, b, w in zip(edges.tolist(), edges[1:].tolist(), width.tolist())], pa.binary()), width


def wide(data: bytes, width: int) -> bytes:
    """A chunk's ids in four bytes each."""
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, in its reflected bit order."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs after n_bytes of zeros: times x to the 8 * n_bytes."""
    out = crc.astype(np.uint32)
    power = np.full(1, 1 << (31 - 8), np.uint32)  # x**8
    left = n_bytes.astype(np.int64).copy()
    while (left > 0).any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            out[odd] = _times(out[odd], np.broadcast_to(power, len(odd)).copy())
        power = _times(power, power)
        left >>= 1
    return out


def _staged(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Each document with its chunks, where it was read."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for some in text_runs(batch, 2):
                ids, counts = enc.encode(some.column(2).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                ends = np.cumsum(counts + 1)
                edges = np.concatenate([[0], cuts(ids, ends)]).astype(np.int64)
                whole = memoryview(ids).cast("B")
                digests = [hashlib.sha256(whole[4 * a : 4 * b]).digest() for a, b in zip(edges.tolist(), edges[1:].tolist())]
                data, width = narrow(ids, edges)
                chunks = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(np.diff(edges).astype(np.int32)), pa.array(width.astype(np.int32)), data], ["digest", "n", "width", "ids"])
                offsets = np.concatenate([[0], np.searchsorted(edges, ends)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(offsets), chunks)], ["doc_id", "row", "n_tokens", "chunks"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, row long, n_tokens long, chunks array<struct<digest: binary, n: int, width: int, ids: binary>>")


def _roots(df: DataFrame, writing: bool) -> DataFrame:
    """Adds each document's Merkle root and, when writing, its place in its range partition; when reading, the bytes
    behind each of its chunks."""

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            roots = pa.array([merkle_root(x) for x in batch.column("digests").to_pylist()], pa.binary())
            if writing:
                out, names = [roots, pa.array(np.full(len(n), part, np.int32)), pa.array(total + np.cumsum(n) - n)], ["root", "part", "local_start"]
                total += int(n.sum())
            else:
                lists = batch.column("lengths")
                size, offsets = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                upto = np.concatenate([[0], np.cumsum(size)])
                behind = 4 * (np.repeat(n + upto[offsets[:-1]], np.diff(offsets)) - upto[1:])
                out, names = [roots, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(behind))], ["found_root", "behind"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *names])

    extra = ", root binary, part int, local_start long" if writing else ", found_root binary, behind array<long>"
    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + extra)


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> str:
    """Write the store of ``docs`` under ``path``."""
    spark = docs.sparkSession
    temp = fresh_path(spark, "store-staged")
    staged = _staged(docs, tokenizer, end_id)
    staged.write.option("compression", "zstd").parquet(temp)
    staged = spark.read.schema(staged.schema).parquet(temp)
    each = staged.select(F.explode("chunks").alias("c")).select("c.digest", "c.width", "c.ids")
    each.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    slim = staged.select("doc_id", "row", "n_tokens", F.col("chunks.digest").alias("digests"), F.col("chunks.n").alias("lengths"))
    placed = _roots(in_id_order(slim, ["doc_id", "row"]), writing=True).drop("row")
    recipes = f"{path}/recipes-local"
    placed.write.parquet(recipes)
    placed = spark.read.schema(placed.schema).parquet(recipes)
    base = partition_offsets(placed, "part", "n_tokens")  # a row per partition, so small enough to broadcast
    placed.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start").write.parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    forget(spark, temp)
    forget(spark, recipes)
    return path


def _manifest(recipes: DataFrame) -> DataFrame:
    """Per partition a digest over its documents' roots in order: roots of bounded runs, then over the runs."""
    runs = recipes.groupBy("part", F.expr("start div 65536").alias("run")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("root").alias("root")))), lambda x: x["root"])), 256).alias("root"))
    return runs.groupBy("part").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("run", "root"))), lambda x: x["root"])), 256).alias("root"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, crc, n_bytes of every stored chunk, each verified."""

    def run(batches):
        for batch in batches:
            data, width = batch.column(1), batch.column(2).to_numpy()
            if len(width) and (width == 2).all():  # all at once
                offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(width) + 1]
                ids = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                whole, at = (b"" if len(ids) % 2 else wide(ids.tobytes(), 2)), (2 * (offsets - offsets[0])).tolist()
                bodies = [whole[a:b] for a, b in zip(at, at[1:])]
            else:
                bodies = list(map(wide, data.to_pylist(), width.tolist()))
            for d, b in zip(batch.column(0).to_pylist(), bodies):
                if hashlib.sha256(b).digest() != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array([len(b) for b in bodies], pa.int64())], ["digest", "crc", "n_bytes"])

    return spark.read.schema("digest binary, ids binary, width int").parquet(f"{path}/chunks").mapInArrow(run, "digest binary, crc long, n_bytes long")


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    found, stored = _manifest(recipes), spark.read.parquet(f"{path}/manifest")
    if not (found.exceptAll(stored).isEmpty() and stored.exceptAll(found).isEmpty()):
        raise ValueError("recipes do not match the manifest")
    found = _roots(recipes.select("doc_id", "start", "n_tokens", "digests", "lengths", "root"), writing=False)
    return found.withColumn("root", F.when(F.col("root") == F.col("found_root"), F.col("root")).otherwise(F.raise_error(F.lit("a recipe does not match its Merkle root")))).drop("found_root")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from verified files."""
    each = F.explode(F.arrays_zip("digests", "behind"))
    parts = verified_recipes(spark, path).where(F.col("root").isNotNull()).select("doc_id", "start", "n_tokens", each.alias("p")).select("doc_id", "start", "n_tokens", F.col("p.digests").alias("digest"), "p.behind")

    def shares(batches):
        for batch in batches:
            if batch.column("crc").null_count:
                raise ValueError("chunks of a document are missing")
            crc = moved(batch.column("crc").to_numpy(), batch.column("behind").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "start", "n_tokens")), pa.array(crc.astype(np.int64)), batch.column("n_bytes")], ["doc_id", "start", "n_tokens", "share", "n_bytes"])

    held = parts.join(_chunks(spark, path), "digest", "left").mapInArrow(shares, "doc_id long, start long, n_tokens long, share long, n_bytes long")
    out = held.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n_bytes").alias("n_bytes"))
    whole = F.col("n_bytes") == 4 * F.col("n_tokens")
    return out.select("doc_id", "start", "n_tokens", F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("chunks of a document are missing"))).alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit): whole documents put together from their chunks."""
    parts = verified_recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("nth", "digest"))
    body = spark.read.schema("digest binary, ids binary, width int").parquet(f"{path}/chunks")

    def run(batches):
        for batch in batches:
            if any(p["ids"] is None for parts in batch.column(2).to_pylist() for p in parts):
                raise ValueError("chunks of a document are missing")
            data = [b"".join(wide(p["ids"], p["width"]) for p in parts) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    rows = parts.join(body, "digest", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("nth", "ids", "width"))).alias("parts"))
    return rows.select("doc_id", "start", "parts").mapInArrow(run, "doc_id long, start long, ids binary")


def op4_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_checksums(spark, write_store(table(spark, sf_dir, "documents"), fresh_path(spark, "store")))
