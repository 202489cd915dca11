"""Vectors that have been paid for: a store of embeddings by the content of their texts, asked before an embedder is.

A text's key is its SHA-256; each model has a folder of its own, in buckets by key.  ``embedded`` joins rows with what is stored, asks the
embedder for the distinct texts that are missing, stores their vectors, and joins these: so a text is asked for once, whatever the
number of rows that say it or of runs.  A null text has no vector and is never asked for.

The store holds no texts.  ``erase`` takes the vectors of some texts out again (others that say the same are then asked for anew):
the touched buckets are written without them before the old files go, so a failure leaves them whole and can be repeated.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.sources import folders

BUCKETS = 64
_STORED = "key string, embedding array<float>, run string, bucket int"


def key_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS)).cast("int")


class VectorCache:
    """``model`` names what makes the vectors: another model, or another length, is another name."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()[:16]}"

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> VectorCache:
        """The cache that lies in a folder, whatever its model."""
        out = cls.__new__(cls)
        out.spark, out.path = spark, folder
        return out

    def stored(self) -> DataFrame:
        """key, embedding, once each."""
        return self._files().groupBy("key").agg(F.min_by("embedding", "run").alias("embedding"))

    def _files(self) -> DataFrame:
        if not folders.names_in(self.spark, self.path):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(self.path)

    def _put(self, rows: DataFrame) -> str:
        run = uuid.uuid4().hex
        rows.withColumn("bucket", _bucket(F.col("key"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/run={run}")
        return run

    def embedded(self, rows: DataFrame, embed, text: str = "content", to: str = "embedding", batch_size: int | None = None) -> DataFrame:
        """rows with the vectors of their texts, in ``to``."""
        keyed = rows.drop(to).withColumn("qw_key", key_of(F.col(text)))
        asked = keyed.where(F.col(text).isNotNull()).groupBy("qw_key").agg(F.first(text).alias("qw_text"))
        missing = asked.join(self.stored().select(F.col("key").alias("qw_key")), "qw_key", "left_anti")
        path = folders.shared_path(self.spark, "texts")
        missing.write.parquet(path)  # the embedder is asked for these and no others, each once
        try:
            missing = self.spark.read.schema("qw_key string, qw_text string").parquet(path)
            if not missing.isEmpty():
                self._put(missing.select(F.col("qw_key").alias("key"), embed.column(F.col("qw_text"), batch_size).cast("array<float>").alias("embedding")))
        finally:
            folders.remove(self.spark, path)
        return keyed.join(self.stored().select(F.col("key").alias("qw_key"), F.col("embedding").alias(to)), "qw_key", "left").drop("qw_key")

    def erase(self, texts: DataFrame, text: str = "content") -> None:
        """Take out the vectors of these texts."""
        gone = texts.where(F.col(text).isNotNull()).select(key_of(F.col(text)).alias("key")).distinct()
        touched = [r[0] for r in gone.select(_bucket(F.col("key"))).distinct().collect()]  # BUCKETS at most
        there = self._files().where(F.col("bucket").isin(touched))
        if not touched or there.join(gone, "key", "left_semi").isEmpty():
            return
        old = [n for n in folders.names_in(self.spark, self.path) if n.startswith("run=")]
        self._put(there.groupBy("key").agg(F.min_by("embedding", "run").alias("embedding")).join(gone, "key", "left_anti"))
        for name in old:
            for b in touched:
                folders.remove(self.spark, f"{self.path}/{name}/bucket={b}")
        self.spark.catalog.refreshByPath(self.path)
