"""The table as a data source: pushed filters, moved ids, slices, streams, appended rows."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarrywell.schema import RECORD
from quarrywell.sources import datasource
from quarrywell.sources.datasource import MemoryReader, murmur, register, take_in
from quarrywell.sources.table import MemoryTable

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


def row(k, user, content):
    return (f"m{k}", user, content, [1.0, float(k)], 2, T0, T0, "user_stated", 0.5, "active", "{}", ["t"], k)


def put(table, *rows):
    table.store(table.spark.createDataFrame(list(rows), RECORD))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    register(spark)
    t = MemoryTable(spark, f"file://{tmp_path_factory.mktemp('source')}/t", buckets=8)
    put(t, *(row(k, f"u{k % 10}", f"text {k}") for k in range(200)))
    put(t, row(3, "u4", "moved"), row(5, "u5", "new"), row(500, "ü", "other"))
    t.delete_by_user("u7")
    return t


def test_murmur_is_sparks_hash(spark):
    r = random.Random(1)
    some = ["", "a", "abcd", "abcde", "ü", "日本語", *("".join(chr(r.randint(32, 0x2FF)) for _ in range(r.randint(0, 20))) for _ in range(60))]
    assert {x["s"]: x["h"] for x in spark.createDataFrame([(s,) for s in some], "s string").select("s", F.hash("s").alias("h")).collect()} == {s: murmur(s) for s in some}


def test_reads_what_the_table_reads(spark, table, monkeypatch):
    read = lambda: spark.read.format("memories").load(table.path)
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(read()) == key(table.get_all()) and read().schema == RECORD
    for user in ("u4", "u3", "ü", "u7", "nobody"):
        assert key(read().where(F.col("user_id") == user)) == key(table.get_all().where(F.col("user_id") == user))
    assert key(read().where("user_id IN ('u1', 'u2') AND seq > 50")) == key(table.get_all().where("user_id IN ('u1', 'u2') AND seq > 50"))
    assert key(read().where("memory_id = 'm3'")) == key(table.get("m3")) and read().where("memory_id = 'm3' AND user_id = 'u3'").count() == 0
    assert read().where("user_id = 'u1'").select("content").count() == table.count("u1")


def test_filters_are_pushed(spark, table):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    whole, one, some = (MemoryReader(table.path) for _ in range(3))
    assert list(one.pushFilters([EqualTo(("user_id",), "u4"), GreaterThan(("seq",), 3)])) == [GreaterThan(("seq",), 3)]
    assert list(some.pushFilters([In(("user_id",), ("u1", "u2")), EqualTo(("memory_id",), "m1")])) == []
    assert len(one.partitions()) == 1 and len(some.partitions()) <= 2 < len(whole.partitions())
    assert [x["content"] for b in some.read(some.partitions()[0]) for x in b.to_pylist()] in ([], ["text 1"])


def test_large_buckets_in_slices(table, monkeypatch):
    monkeypatch.setattr(datasource, "SLICE", 10)
    whole = MemoryReader(table.path)
    parts = whole.partitions()
    assert len(parts) > 16
    got = [x["memory_id"] for p in parts for b in whole.read(p) for x in b.to_pylist()]
    assert sorted(got) == sorted(r["memory_id"] for r in table.get_all().collect())


def test_stream_of_writes(spark, tmp_path):
    register(spark)
    t = MemoryTable(spark, f"file://{tmp_path}/t", buckets=4)
    seen = []

    def run():
        seen.clear()
        spark.readStream.format("memories").load(t.path).writeStream.foreachBatch(lambda b, _: seen.extend((r["memory_id"], r["content"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(seen)

    put(t, row(1, "a", "one"), row(2, "b", "two"))
    assert run() == [("m1", "one"), ("m2", "two")]
    assert run() == []
    put(t, row(1, "b", "moved"))
    put(t, row(3, "c", "three"))
    t.compact()
    assert run() == [("m1", "moved"), ("m3", "three")]


def test_appends_come_in(spark, tmp_path):
    register(spark)
    t = MemoryTable(spark, f"file://{tmp_path}/t", buckets=4)
    put(t, row(1, "a", "old"))
    rows = spark.createDataFrame([row(1, "b", "new"), row(2, "b", "two"), (*row(3, "c", "x")[:3], None, None, *row(3, "c", "x")[5:])], RECORD)
    rows.repartition(2).write.format("memories").mode("append").save(t.path)
    assert t.get_all().count() == 1  # what came in counts once it is taken in
    with pytest.raises(Exception):
        rows.withColumn("content", F.raise_error(F.lit("broken"))).write.format("memories").mode("append").save(t.path)
    assert take_in(t) == 3 and take_in(t) == 0
    assert sorted((r["memory_id"], r["user_id"], r["content"]) for r in t.get_all().collect()) == [("m1", "b", "new"), ("m2", "b", "two"), ("m3", "c", "x")]
    assert not datasource._names(f"{t.path}/inbox")
    with pytest.raises(Exception, match="only be appended"):
        rows.write.format("memories").mode("overwrite").save(t.path)
