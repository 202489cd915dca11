"""Who owns an id, what a deletion leaves on disk, and what is read for one id or one user."""

import json
import os
import re
from datetime import datetime, timezone
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from quarrywell.embedding import FunctionEmbedder
from quarrywell.engine import Memory
from quarrywell.schema import RECORD, STATES
from quarrywell.sources import folders
from quarrywell.sources.table import MemoryTable

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


def row(k, user, content, seq=None, v=(1.0, 0.0)):
    return (f"m{k}", user, content, list(v), 2, T0, T0, "user_stated", 0.5, "active", "{}", ["t"], k if seq is None else seq)


@pytest.fixture()
def table(spark, tmp_path):
    return MemoryTable(spark, f"file://{tmp_path}/table", buckets=8)


def put(table, *rows):
    table.store(table.spark.createDataFrame(list(rows), RECORD))


def held(df):
    return sorted((r["memory_id"], r["user_id"], r["content"], r["seq"]) for r in df.collect())


def on_disk(table, word):
    """Parquet files under the table that hold the word in a text, whatever states say."""
    out = []
    for f in Path(table.path.removeprefix("file://")).rglob("*.parquet"):
        t = pq.read_table(f)
        if "content" in t.column_names and any(word in (c or "") for c in t.column("content").to_pylist()):
            out.append(str(f))
    return out


def power_cut(*_):
    raise RuntimeError("power cut")


def test_an_id_belongs_to_whoever_wrote_it_last(table):
    put(table, row(1, "A", "text of A"), row(2, "A", "other"), row(3, "B", "third"))
    put(table, row(1, "B", "text of B", seq=99))
    assert held(table.get_all_by_user("A")) == [("m2", "A", "other", 2)] and table.count("A") == 1
    assert held(table.get_all_by_user("B")) == [("m1", "B", "text of B", 1), ("m3", "B", "third", 3)]  # it keeps its place
    assert held(table.get("m1")) == [("m1", "B", "text of B", 1)]
    asked = table.spark.createDataFrame([("A",), ("B",), ("nobody",), (None,)], "user_id string")
    assert held(table.of_users(asked)) == held(table.get_all())
    assert table.delete_by_user("B") == 2
    assert held(table.get_all()) == [("m2", "A", "other", 2)] and held(table.get("m1")) == [] and table.count("B") == 0
    assert not on_disk(table, "text of")  # what A had under the id is gone with it
    assert [r[0] for r in table.get_all_users().collect()] == ["A"]


def test_moves_back_and_forth(table):
    users = ["A", "B", "C", "B", "A", "D"]
    for n, u in enumerate(users):
        put(table, row(1, u, f"by {u} {n}"), row(10 + n, u, "own"))
        for v in set(users):
            want = [f"by {u} {n}"] if v == u else []
            assert [r["content"] for r in table.get_all_by_user(v, STATES).where("memory_id = 'm1'").collect()] == want
    table.compact()
    assert [r[:3] for r in held(table.get("m1"))] == [("m1", "D", "by D 5")] and len(on_disk(table, "by ")) == 1
    assert table.delete_by_user("A") == 2 and table.count("D") == 2  # users that have had the id stay or go without it
    assert table.delete_by_id("m1") and not table.delete_by_id("m1") and not on_disk(table, "by ")
    put(table, row(1, "C", "anew", seq=7))
    assert held(table.get("m1")) == [("m1", "C", "anew", 7)]


def test_former_owner_goes_first(table):
    put(table, row(1, "A", "first secret"))
    put(table, row(1, "B", "second text"))
    assert table.delete_by_user("A") == 0 and not on_disk(table, "secret")
    assert held(table.get_all_by_user("B")) == [("m1", "B", "second text", 1)] == held(table.get_all())


def test_rows_of_one_write(table):
    put(table, row(1, "A", "early", seq=1), row(1, "B", "late", seq=2), row(2, "A", "x"), row(2, "A", "x"))
    assert held(table.get_all()) == [("m1", "B", "late", 1), ("m2", "A", "x", 2)]


def test_nothing_forgotten_stays(table, monkeypatch):
    """A crash between the state that erases and the removal of files: the next write removes them, or compact, or clean."""
    for k, after in enumerate((lambda: table.delete_by_id("nothing"), table.compact, lambda: put(table, row(500, "v", "more")), table.clean)):
        put(table, row(k, "u", f"forgotten {k}"), row(100 + k, "u2", "kept"))
        table.clean()
        with monkeypatch.context() as m:
            m.setattr(folders, "remove", power_cut)
            with pytest.raises(RuntimeError):
                table.delete_by_user("u") if k % 2 else table.delete_by_id(f"m{k}")
        assert table.get(f"m{k}").count() == 0
        after()
        assert not on_disk(table, "forgotten") and table.count("u2") == k + 1
    assert sum(len(os.listdir(f"{table.path.removeprefix('file://')}/{p}")) for p in ("staged",) if os.path.isdir(f"{table.path.removeprefix('file://')}/{p}")) == 0


def test_nothing_of_a_failed_write_stays(spark, tmp_path, monkeypatch):
    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(lambda ts: [[1.0, float(len(t))] for t in ts], 2), now=lambda: T0)
    memory.remember("u", "kept text")
    with monkeypatch.context() as m:
        m.setattr(memory.table, "_commit", power_cut)
        with pytest.raises(RuntimeError):
            memory.remember("u", "a secret that was never stored")
    assert on_disk(memory.table, "secret") and memory.table.get_all().count() == 1
    assert memory.forget("u") == 1
    assert not on_disk(memory.table, "secret") and not on_disk(memory.table, "kept")


def scans(df):
    return re.findall(r"FileScan parquet \[[^\]]*\].*", df._jdf.queryExecution().sparkPlan().toString())


def test_get_reads_one_bucket(table, tmp_path):
    put(table, *(row(k, f"u{k % 40}", f"text {k}") for k in range(400)))
    one = table.get("m7")
    assert held(one) == [("m7", "u7", "text 7", 7)]
    (scan,) = scans(one)
    assert "user_bucket" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1] and "EqualTo(memory_id,m7)" in scan
    total = len(list(Path(table.path.removeprefix("file://")).glob("log/*/*/*.parquet")))
    read = one._jdf.queryExecution().sparkPlan().toString()
    assert total >= 8 and re.search(r"PartitionFilters: \[[^\]]*user_bucket#\d+ = \d+", read)
    some = next(Path(table.path.removeprefix("file://")).glob("log/*/*/*.parquet"))
    meta = pq.ParquetFile(some).metadata.row_group(0)
    at = next(k for k in range(meta.num_columns) if meta.column(k).path_in_schema == "memory_id")
    assert meta.column(at).statistics.has_min_max
    assert held(table.get("m401")) == []


def test_a_user_is_read_from_one_bucket(table):
    put(table, *(row(k, f"u{k % 40}", f"text {k}") for k in range(400)))
    mine = table.get_all_by_user("u3")
    assert mine.count() == 10
    (scan,) = scans(mine)
    assert "user_bucket" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1] and "owner" in scan.split("PushedFilters")[1]


def test_recall_scans_its_user_once(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(lambda ts: [[1.0, float(len(t))] for t in ts], 2), now=lambda: T0)
    memory.table.store(spark.createDataFrame([row(k, f"u{k % 20}", "word " * k, v=(1.0, float(k))) for k in range(200)], RECORD))
    found = memory.recall("u3", "word word")
    assert found.count() == 5
    (scan,) = scans(found)
    assert "user_bucket" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1]


def test_files_of_before_the_index(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarrywell.sources.table import bucket_of

    path = f"file://{tmp_path}/old"
    rows = spark.createDataFrame([row(k, f"u{k % 3}", f"text {k}") for k in range(9)], RECORD)
    rows.drop("tags").withColumn("user_bucket", bucket_of(F.col("user_id"))).write.partitionBy("user_bucket").parquet(f"{path}/log/write=1")
    t = MemoryTable(spark, path)
    assert t.count("u1") == 3 and t.get_all().count() == 9
    put(t, row(4, "u2", "moved"))
    assert t.count("u1") == 2 and t.count("u2") == 4 and held(t.get("m4"))[0][1:3] == ("u2", "moved") and t.get("m5").first()["tags"] == []
    assert t.delete_by_user("u2") == 4 and t.get_all().count() == 5


def test_many_ids_are_joined_not_listed(table, monkeypatch):
    from quarrywell.sources import table as module

    monkeypatch.setattr(module, "FEW", 3)
    put(table, *(row(k, "A", "a") for k in range(20)))
    put(table, *(row(k, "B", "b") for k in range(10)))
    assert table.count("A") == 10 and table.count("B") == 10


def test_export_array_replaces_whole(table, tmp_path, monkeypatch):
    from quarrywell.sources import json_files

    path = f"{tmp_path}/all.json"
    assert table.export_array(path) == 0 and json.load(open(path)) == []
    put(table, *(row(k, "u", f"line\n\"{k}\" é", seq=50 - k) for k in range(50)))
    assert table.export_array(path) == 50
    got = json.load(open(path))
    assert [r["memory_id"] for r in got] == [f"m{k}" for k in range(49, -1, -1)] and got[0]["content"] == 'line\n"49" é'
    assert re.fullmatch(r"2024-02-01T00:00:00\.000000\+00:00", got[0]["created_at"]) and datetime.fromisoformat(got[0]["created_at"]) == T0
    put(table, row(77, "u", "more"))
    with monkeypatch.context() as m:
        m.setattr(json_files, "assembled", power_cut)
        with pytest.raises(RuntimeError):
            table.export_array(path)
    assert len(json.load(open(path))) == 50  # the old file stays until the new one is whole
    assert table.export_array(path) == 51 and len(json.load(open(path))) == 51
    assert {n for n in os.listdir(tmp_path) if not n.endswith(".crc")} == {"all.json", "table"}


def test_export_array_through_the_file_system(table, tmp_path, monkeypatch):
    """Where files are not in a POSIX folder one stream joins them."""
    put(table, *(row(k, "u", f"text {k}") for k in range(20)))
    at = folders.at

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):
            return type("U", (), {"getScheme": lambda _: "other"})()

    from quarrywell.sources import json_files

    monkeypatch.setattr(json_files.folders, "at", lambda s, p: (Fs(at(s, p)[0]), at(s, p)[1]))
    rows = table.get_all()
    parts = f"file://{tmp_path}/parts"
    rows.orderBy("seq").selectExpr("concat(if(seq = 0, '', ','), to_json(struct(memory_id)))").write.text(parts)
    json_files.assembled(table.spark, parts, f"file://{tmp_path}/joined.json", b"[\n", b"]\n")
    assert [r["memory_id"] for r in json.load(open(f"{tmp_path}/joined.json"))] == [f"m{k}" for k in range(20)]


def test_recency_is_that_of_the_last_access(spark, tmp_path):
    """Two rows alike but for the last access: the one accessed now comes first, with the scores of the formula."""
    from datetime import timedelta

    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(lambda ts: [[1.0, 0.0] for _ in ts], 2), now=lambda: T0)
    at = lambda k, accessed: (f"m{k}", "u", "same words", [1.0, 0.0], 2, T0 - timedelta(days=900), accessed, "user_stated", 0.8, "active", "{}", [], k)
    memory.table.store(spark.createDataFrame([at(0, T0 - timedelta(days=365)), at(1, T0), at(2, T0 - timedelta(hours=168))], RECORD))
    got = {r["memory_id"]: r["score"] for r in memory.recall("u", "nothing", hybrid_search=False).collect()}
    assert got["m1"] == pytest.approx(0.5 + 0.3 + 0.16) and got["m2"] == pytest.approx(0.5 + 0.15 + 0.16) and got["m0"] == pytest.approx(0.66, abs=1e-6)
    assert [r["memory_id"] for r in memory.recall("u", "nothing").collect()] == ["m1", "m2", "m0"]


def test_recall_since_spends_tokens_before_time(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(lambda ts: [[1.0, 0.0] for _ in ts], 2), now=lambda: T0)
    memory.table.store(spark.createDataFrame([row(k, "u", "one two three four", v=(1.0, 0.1 * k)) for k in range(4)], RECORD))
    assert memory.recall_since("u", "one", hours=1).count() == 4
    assert memory.recall_since("u", "one", hours=1, max_tokens=11).count() == 2
    with pytest.raises(ValueError):
        memory.recall_many(spark.createDataFrame([(1, "u", "x")], "query_id long, user_id string, query string"), top_k=0).count()
