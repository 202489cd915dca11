"""What the operators of this subpackage share: the tables' places, the shared folder, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes after which a batch from the JVM to Python ends.  Spark's own 64 MB, held several times over on both sides of each
#: task, is much for rows of long texts or whole blocks.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Set the session's limit on the bytes of an Arrow batch, unless it has one."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (tests, local mode) is a folder of this machine set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarrywell-')}"
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    short_batches(spark)
    return f"{shared_dir(spark)}/quarrywell/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors
    cost a reread, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written path, through the file system that its scheme names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files under ``fresh_path`` that these tables read, once what needs them is written.  Other files stay."""
    for df in tables:
        for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search(r"/quarrywell/[a-z_-]+-[0-9a-f]{32}$", p):
                forget(df.sparkSession, p)


def text_runs(batch, column: int, most: int = 1 << 22):
    """An Arrow batch in slices of about ``most`` bytes of the text in ``column``; a longer text ends its slice."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(size + 1) // most
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edge, edge[1:]):
        if b > a:
            yield batch.slice(a, b - a)
