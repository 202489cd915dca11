"""The shared folder of a session, and small files in any file system that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, which driver and executors see; only where the session has none, and runs on
    this machine alone, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarrywell-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/quarrywell/{kind}-{uuid.uuid4().hex}"


def at(spark: SparkSession, path: str):
    """The Hadoop file system and path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, parts) -> None:
    """Write a file from pieces of bytes; readers see all of it or nothing.  An existing file is an error."""
    fs, p = at(spark, path)
    temp = at(spark, f"{path}.{uuid.uuid4().hex}.part")[1]
    out, held = fs.create(temp, True), bytearray()
    try:
        for part in parts:
            held += part
            if len(held) >= 1 << 20:
                out.write(held)
                held = bytearray()
        out.write(held)
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(temp, p):
        fs.delete(temp, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def remove_but_last(spark: SparkSession, path: str) -> None:
    """Keep only the last file of a folder, by name."""
    for name in names_in(spark, path)[:-1]:
        remove(spark, f"{path}/{name}")


def put_over(spark: SparkSession, temp: str, path: str) -> None:
    """Move a finished file to path, in place of what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = at(spark, path)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(at(spark, temp)[1], p, how)


def text_of(spark: SparkSession, path: str) -> str:
    fs, p = at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def bytes_in(spark: SparkSession, path: str) -> int:
    fs, p = at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
