"""Streaming ingest: each micro-batch goes through the ordered fold and is stored.

A batch reads what it touches only: the rows of its own users, from their buckets, and of the ids that came in before those in its own
id buckets.  Ids that were merged into other rows are in no index, so they are kept beside the table, by id bucket.  A
batch that comes again, at once after a failure or later under a new checkpoint, so finds nothing new and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrywell.operators.dedup import folded
from quarrywell.sources import folders
from quarrywell.sources.table import MemoryTable, bucket_of

_TAKEN = "memory_id string, id_bucket int"


def taken(table: MemoryTable, ids: DataFrame) -> DataFrame:
    """memory_id of those ids that came in before, stored or merged."""
    path, stored = f"{table.path}/taken", table.known_ids(ids)
    if not folders.names_in(table.spark, path):
        return stored
    ids = ids.select("memory_id", bucket_of(F.col("memory_id")).alias("id_bucket"))
    touched = [r[0] for r in ids.select("id_bucket").distinct().collect()]  # as many as there are buckets at most
    merged = table.spark.read.schema(_TAKEN).parquet(path).where(F.col("id_bucket").isin(touched))
    return stored.unionByName(merged.join(ids, ["memory_id", "id_bucket"], "left_semi").select("memory_id")).distinct()


def ingest_batch(batch: DataFrame, table: MemoryTable, now, threshold: float = 0.85, low: float = 0.65) -> None:
    spark, scratch = table.spark, [folders.shared_path(table.spark, "batch"), folders.shared_path(table.spark, "ingest")]
    batch.groupBy("memory_id").agg(F.min_by(F.struct(*batch.columns), F.coalesce("seq", F.lit(0))).alias("r")).select("r.*").write.parquet(scratch[0])
    rows = spark.read.schema(batch.schema).parquet(scratch[0])
    fresh = rows.join(taken(table, rows.select("memory_id")), "memory_id", "left_anti").select(*batch.columns)
    folded(fresh, table.of_users(rows.select("user_id")), now, threshold, low, scratch=scratch).write.parquet(scratch[1])
    out = spark.read.parquet(scratch[1])
    if not out.isEmpty():
        table.store(out.drop("sources"))
        merged = out.select("memory_id", F.explode("sources").alias("source")).where("source <> memory_id").select(F.col("source").alias("memory_id"), bucket_of(F.col("source")).alias("id_bucket"))
        merged.repartition("id_bucket").write.mode("append").partitionBy("id_bucket").parquet(f"{table.path}/taken")
    for path in scratch:
        folders.remove(spark, path)


def ingest(stream: DataFrame, table: MemoryTable, now, checkpoint: str, threshold: float = 0.85, low: float = 0.65, once: bool = True) -> StreamingQuery:
    """``stream`` has the columns of the memory table."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, table, now, threshold, low)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
