"""Packing: concatenate and cut.

Documents are tokenised in id order, range partition by range partition, each with an end id.  The first pass
writes the ids with each document's place inside its partition; prefix sums over the partitions' token totals
then give global places, and the second pass cuts the one long stream into windows of ``width`` ids.  A boundary
record says which part of which document lies where in which sequence; only the last sequence can need padding,
up to the next power of two.

Defined results: a null or empty text is its end id alone; rows with a null id come first; rows with equal ids
follow one another in the order of reading, each a document of its own; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import fresh_path, table, text_runs
from quarrywell.llm.encoders import encoder
from quarrywell.llm.ordering import in_id_order, partition_offsets

TOKENIZER, END_ID, WIDTH = "word_bpe_49k.json", 2, 4096
STAGED = "doc_id long, part int, local_start long, n long, ids binary"


def encode_in_order(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, part, local_start, n, ids (little-endian unsigned 32-bit) in id order."""

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            for some in text_runs(batch, 1):
                ids, counts = enc.encode(some.column(1).to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                starts = np.cumsum(counts) - counts
                offsets = np.append(starts, len(ids)) * 4
                if offsets[-1] >= 2**31:
                    data = pa.array([ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), counts.tolist())], pa.large_binary()).cast(pa.binary())
                else:
                    data = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(total + starts), pa.array(counts), data], ["doc_id", "part", "local_start", "n", "ids"])
                total += int(counts.sum())

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_id_order(source, ["doc_id"]).mapInArrow(run, STAGED)


def cut(staged: DataFrame, width: int) -> DataFrame:
    """Boundary records of the fixed windows, from documents with their global places."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            ids_of = batch.column(3)
            begin, count = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = begin // width, (begin + count - 1) // width
            pieces = last - first + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + nth
            at = np.maximum(seq * width, begin[row])
            length = np.minimum((seq + 1) * width, begin[row] + count[row]) - at
            start = at - begin[row]
            crc, held, held_row = np.empty(len(row), np.int64), b"", -1
            for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != held_row:
                    held, held_row = memoryview(ids_of[r].as_buffer()), r
                crc[k] = zlib.crc32(held[4 * s : 4 * (s + n)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, count[row], seq, at - seq * width))], names)

    return staged.select("doc_id", "start", "n", "ids").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = fresh_path(spark, "packing")
    encode_in_order(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(STAGED).parquet(path)
    base = partition_offsets(staged, "part", "n")  # a row per partition, so small enough to broadcast
    placed = staged.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))
    return cut(placed, width)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
