"""The table and the facade, end to end on small data."""

import json
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from quarrywell.embedding import FunctionEmbedder
from quarrywell.engine import Memory
from quarrywell.operators import dedup, recall
from quarrywell.schema import RECORD

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


def hot(texts):
    """A vector for each text by its letters, so that equal texts agree and others do not."""
    out = []
    for t in texts:
        v = np.zeros(26)
        for c in t.lower():
            if c.isalpha() and c.isascii():
                v[ord(c) - 97] += 1
        out.append(v.tolist())
    return out


@pytest.fixture()
def memory(spark, tmp_path):
    return Memory(spark, f"file://{tmp_path}/table", FunctionEmbedder(hot, 26), now=lambda: T0)


def test_remember_recall_forget(memory):
    a = memory.remember("u", "pizza pasta", tags=["food"])
    b = memory.remember("u", "zzz qqq", importance=7)
    assert memory.remember("u", "pasta pizza") == a  # same letters: merged
    rows = {r["memory_id"]: r for r in memory.table.get_all().collect()}
    assert rows[a]["content"] == "pasta pizza" and rows[a]["tags"] == [] and rows[b]["importance"] == 1.0
    assert memory.recall("u", "pizza").first()["memory_id"] == a
    assert memory.context_block("u", "pizza", 1) == "Relevant context from memory:\n- pasta pizza"
    assert memory.context_block("nobody", "pizza") == ""
    assert memory.stats("u")["total"] == 2 and memory.stats("x")["total"] == 0 and memory.stats("x")["avg_importance"] == 0
    assert memory.list_users() == ["u"]
    assert memory.forget("u", b) == 1 and memory.forget("u", b) == 0 and memory.forget("u") == 1
    assert memory.table.get_all().count() == 0


def test_update_tags_since(memory, spark):
    a, b = memory.remember_many("u", ["abc", "xyz"], tags=["cat"])
    assert {r["memory_id"] for r in memory.recall_by_tag("u", "cat").collect()} == {a, b}
    assert memory.recall_by_tag("u", "category").count() == 0
    assert memory.update(a) == a and memory.update(a, importance=0) == a and memory.table.get(a).first()["importance"] == 0
    with pytest.raises(ValueError):
        memory.update("missing", content="x")
    assert memory.recall_since("u", "abc", hours=1).count() == 2
    memory.now = lambda: T0 + timedelta(hours=5)
    assert memory.recall_since("u", "abc", hours=1).count() == 0
    with pytest.raises(ValueError):
        memory.recall("u", " ")
    with pytest.raises(TypeError):
        memory.remember("u", "x", importance="high")


def test_export_import(memory, spark, tmp_path):
    memory.remember_many("alice", ["abc", "xyz"], metadata={"k": "v"})
    path = f"file://{tmp_path}/out"
    assert memory.export(path) == 2
    other = Memory(spark, f"file://{tmp_path}/other", FunctionEmbedder(hot, 26), now=lambda: T0)
    assert other.import_from(path) == 2 and other.import_from(path) == 0
    keep = lambda t: sorted((r["memory_id"], r["content"], r["created_at"], json.loads(r["metadata"])["k"]) for r in t.get_all().collect())
    assert keep(other.table) == keep(memory.table)
    file = tmp_path / "array.json"
    file.write_text(json.dumps([{"memory_id": "m1", "user_id": "u", "content": "first", "created_at": "2024-01-01T00:00:00"}, {"memory_id": "m1", "user_id": "u", "content": "again"}], indent=2))
    assert other.import_from(f"file://{file}") == 1
    r = other.table.get("m1").first()
    assert r["content"] == "first" and r["importance"] == 0.5 and r["tags"] == [] and r["lifecycle_state"] == "active"


def test_dimension_guard(memory):
    memory.remember("u", "abc")
    memory.embed = FunctionEmbedder(lambda t: [[1.0, 0.0]] * len(t), 2)
    with pytest.raises(Exception, match="dimension mismatch"):
        memory.recall("u", "abc").collect()
    assert memory.migrate("u", memory.embed) == 1
    assert memory.recall("u", "abc").count() == 1


def test_dimension_guard_holds_whatever_is_selected(memory):
    """No query may leave the check out, one that doesn't ask for the dimension either."""
    memory.remember("u", "abc")
    memory.remember("other", "abc")
    memory.embed = FunctionEmbedder(lambda t: [[1.0] * 8] * len(t), 8)
    with pytest.raises(Exception, match="dimension mismatch"):
        memory.context_block("u", "abc")
    assert memory.context_block("nobody", "abc") == ""


def test_nan_is_no_duplicate(spark):
    nan = float("nan")
    rows = [(f"m{k}", "u", f"text number {k}", v, 2, T0, T0, "user_stated", 0.5, "active", "{}", [], k) for k, v in enumerate([[1.0, 0.0], [0.0, 1.0], [nan, 1.0]])]
    df = spark.createDataFrame(rows, RECORD)
    assert dedup.duplicates(df, df, 0.85).where("new_id <> old_id").count() == 0
    assert dedup.duplicates(df, df, 0.85).where("new_id = 'm2'").count() == 0


def test_ids_that_come_back_are_stored(memory):
    ids = memory.remember_many("u", ["abc", "bca", "cab", "xyz"])
    assert len({*ids[:3]}) == 1 and ids[3] != ids[0]
    old = memory.remember("u", "pizza")
    two = memory.remember_many("u", ["pizza", "zapiz"])
    assert two == [old, old]
    stored = {r["memory_id"] for r in memory.table.get_all().collect()}
    assert {*ids, old} == stored
    assert not os.listdir(f"{memory.path.removeprefix('file://')}/staged") or all(not n.endswith(".parquet") for n in os.listdir(f"{memory.path.removeprefix('file://')}/staged"))


def test_metadata_keeps_its_types(memory, spark, tmp_path):
    meta = {"n": 1, "x": 2.5, "o": {"k": [1, None, "a"]}, "t": True, "z": None}
    a = memory.remember("u", "abc", metadata=meta)
    path = f"{tmp_path}/all.json"
    assert memory.export(path) == 1
    whole = json.loads(open(path).read())
    assert len(whole) == 1 and len(whole[0]) == 13 and whole[0]["metadata"] == meta and whole[0]["score"] == 0.0 and whole[0]["tags"] == []
    other = Memory(spark, f"file://{tmp_path}/other", FunctionEmbedder(hot, 26), now=lambda: T0)
    assert other.import_from(f"file://{path}") == 1
    assert json.loads(other.table.get(a).first()["metadata"]) == meta
    rows = memory.table.get_all()
    found = rows.select(rows.memory_id.alias("new_id"))
    assert json.loads(dedup.flag_conflicts(rows, found).first()["metadata"]) == meta | {"conflict_flagged": True}


def test_a_crash_loses_nothing(memory, monkeypatch):
    """Whatever is interrupted, the table is as before or as after."""
    from quarrywell.sources import folders

    ids = memory.remember_many("u", ["abc", "xyz"])
    memory.remember("v", "mno")
    before = sorted(r["memory_id"] for r in memory.table.get_all().collect())
    with monkeypatch.context() as m:
        m.setattr(memory.table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("power cut")))
        for f in (lambda: memory.forget("u"), lambda: memory.forget("u", ids[0]), memory.table.compact):
            with pytest.raises(RuntimeError):
                f()
            assert sorted(r["memory_id"] for r in memory.table.get_all().collect()) == before
    memory.table.clean()  # what the failures left
    with monkeypatch.context() as m:
        m.setattr(folders, "remove", lambda *_: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(RuntimeError):
            memory.forget("u", ids[0])
    assert sorted(r["memory_id"] for r in memory.table.get_all().collect()) == sorted(set(before) - {ids[0]})
    assert memory.forget("u") == 1 and memory.table.get_all_users().collect()[0][0] == "v" and memory.table.get_all().count() == 1


def test_schema_version(memory):
    assert memory.table.schema_version() == 2 and memory.upgrade() == 2
    memory.table.upgrade_schema(2, 3)
    assert memory.table.schema_version() == 3
    memory.remember("u", "abc")
    assert memory.table.schema_version() == 3 and memory.table.get_all().count() == 1


def test_callback_store(spark, tmp_path):
    from quarrywell.sources.stores import CallbackStore, Store
    from quarrywell.sources.table import MemoryTable

    inner = MemoryTable(spark, f"file://{tmp_path}/t")
    made = CallbackStore(store_fn=inner.store, get_fn=inner.get, get_all_by_user_fn=inner.get_all_by_user, get_all_fn=inner.get_all, update_fn=inner.update)
    assert isinstance(made, Store) and isinstance(inner, Store)
    m = Memory(spark, embed=FunctionEmbedder(hot, 26), store=made, now=lambda: T0)
    a = m.remember("u", "abc", tags=["x"])
    assert m.list_users() == ["u"] and m.recall("u", "abc").first()["memory_id"] == a and m.recall_by_tag("u", "x").count() == 1
    with pytest.raises(NotImplementedError, match="delete_by_user"):
        m.forget("u")
    with pytest.raises(TypeError):
        CallbackStore(nothing_fn=print)


def test_chat_and_tools(memory):
    from quarrywell import ChatMemory
    from quarrywell.tools import call_tool

    chat = ChatMemory("u", memory)
    chat.save_context({"session": "zzz", "input": "abc"}, {"output": "answer"})
    chat.save_context({"session": "zzz"}, {})
    assert [r["content"] for r in memory.table.get_all().collect()] == ["abc"]
    assert chat.load_memory_variables({"session": "zzz", "input": "abc"})["history"].endswith("- abc") and chat.load_memory_variables({})["history"] == ""
    assert call_tool(memory, "recall", {"user_id": "u", "query": "abc"}) == "- abc"
    assert call_tool(memory, "remember", {"user_id": "u", "content": "xyz", "importance": 0.9}).startswith("Stored memory: ")
    assert "- xyz" in call_tool(memory, "context_block", {"user_id": "u", "query": "xyz"})
    chat.clear()
    assert memory.table.get_all().count() == 0 and call_tool(memory, "recall", {"user_id": "u", "query": "abc"}) == "No memories found"
    assert call_tool(memory, "forget", {"user_id": "u"}) == "Deleted 0 memory(ies)" and call_tool(memory, "x", {}) == "Unknown tool: x"
    with pytest.raises(KeyError):
        call_tool(memory, "recall", {"user_id": "u"})


def test_objects_and_settings(memory, spark, monkeypatch):
    from quarrywell import LifecycleState, MemoryObject, MemorySource
    from quarrywell.tools import call_tool, memory_of, settings

    a = memory.remember("u", "abc", metadata={"k": [1]}, tags=["x"], source=MemorySource.AGENT_INFERRED)
    one = MemoryObject.of(memory.recall("u", "abc").first())
    assert one.memory_id == a and one.metadata == {"k": [1]} and one.source is MemorySource.AGENT_INFERRED and one.lifecycle_state is LifecycleState.ACTIVE and one.score > 0
    one.content = "changed"
    memory.table.store(spark.createDataFrame([one.row(3)], RECORD))
    assert memory.table.get(a).first()["content"] == "changed" and [str(x) for x in LifecycleState] == ["active", "decaying", "archived", "deleted"]
    memory.remember("u", "xyz")
    monkeypatch.setenv("QUARRYWELL_TOP_K", "1")
    monkeypatch.setenv("QUARRYWELL_PATH", memory.path)
    assert call_tool(memory, "recall", {"user_id": "u", "query": "abc"}).count("- ") == 1
    assert settings()["top_k"] == 1 and memory_of(spark).table.count("u") == 2 and memory_of(spark).embed.dimension() == 384


def test_owner_counter_and_half_life(memory, spark, tmp_path):
    from quarrywell.schema import Config

    a, b = memory.remember_many("u", ["abc", "xyz"])
    with pytest.raises(ValueError):
        memory.update(a, content="q", user_id="v", strict_owner=True)
    assert memory.update(a, importance=1.0, user_id="u", strict_owner=True) == a
    assert memory.recall("u", "abc", max_tokens=5, token_counter=lambda t: 5).count() == 1
    assert memory.recall("u", "abc", max_tokens=5, token_counter=len).count() == 1
    assert memory.recall("u", "abc", max_tokens=6, token_counter=len).count() == 2
    memory.now = lambda: T0 + timedelta(hours=100)
    slow = memory.recall("u", "abc").first()["score"]
    memory.config = Config(decay_half_life_hours=10)
    assert memory.recall("u", "abc").first()["score"] < slow
    stats = memory.stats("u")
    assert stats["by_lifecycle"] == {"active": 2, "decaying": 0, "archived": 0, "deleted": 0} and stats["by_source"]["user_stated"] == 2 and stats["total_with_tags"] == 0
    with pytest.raises(ValueError):
        memory.migrate("u", memory.embed, 0)
    assert memory.migrate("u", memory.embed, 1) == 2


def test_ingest_of_a_batch_that_comes_again(spark, tmp_path):
    from quarrywell.sources.table import MemoryTable
    from quarrywell.streaming.ingest import ingest_batch

    row = lambda k, content, v: (f"m{k}", "u", content, v, 2, T0, T0, "user_stated", 0.5, "active", "{}", [], k)
    one = spark.createDataFrame([row(1, "first text", [1.0, 0.0]), row(2, "second text", [1.0, 0.01])], RECORD)
    two = spark.createDataFrame([row(3, "third text", [1.0, 0.02])], RECORD)
    table = MemoryTable(spark, f"file://{tmp_path}/t")
    for batch in (one, two, one, two):
        ingest_batch(batch, table, "2024-02-02 00:00:00")
        seen = [(r["memory_id"], r["content"]) for r in table.get_all().collect()]
    assert seen == [("m1", "third text")]


def test_async(memory):
    import asyncio

    assert asyncio.run(memory.aremember_many("u", ["abc"])) and asyncio.run(memory.alist_users()) == ["u"]


def test_compact_keeps_the_snapshot(memory):
    a = memory.remember("u", "abc")
    memory.update(a, content="xyz")
    before = memory.table.get_all().collect()
    memory.table.compact()
    assert memory.table.get_all().collect() == before


def _mmr_model(items, k, lam):
    cos = lambda a, b: 0.0 if a is None or b is None else float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    left, out = list(items), []
    while left and len(out) < k:
        best = max(left, key=lambda r: (lam * r[1] - (1 - lam) * max([0.0, *(cos(r[2], s[2]) for s in out)]), -r[0]))
        left.remove(best)
        out.append(best)
    return [r[0] for r in out]


def test_mmr_against_a_model(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for q in range(25):
        n = int(rng.integers(1, 9))
        items = [(p + 1, float(np.round(1 - 0.1 * p, 1)), None if rng.random() < 0.2 else [float(x) for x in rng.integers(1, 3, 3)]) for p in range(n)]
        want[q] = _mmr_model(items, 4, 0.7)
        rows.append((q, items))
    df = spark.createDataFrame(rows, "q long, items array<struct<pos: int, score: double, v: array<float>>>")
    got = {r[0]: r[1] for r in df.select("q", recall.mmr_positions(F.col("items"), 4, 0.7)).collect()}
    assert got == want


def test_fold_against_a_model(spark):
    def row(k, content, e, user="u"):
        return (f"m{k}", user, content, e, 2, T0, T0, "user_stated", 0.5, "active", "{}", [], k)

    old = spark.createDataFrame([row(0, "i love coffee", [1.0, 0.0])], RECORD)
    new = spark.createDataFrame([row(1, "i hate coffee", [1.0, 0.0]), row(2, "tea house", [1.0, 0.1]), row(3, "far away", [-1.0, 0.0]), row(4, "half way", [0.5, 0.8]), row(5, "x", None)], RECORD)
    got = {r["memory_id"]: r for r in dedup.remember_many(new, old, "2024-02-02 00:00:00").collect()}
    assert got["m1"]["content"] == "i hate coffee" and json.loads(got["m1"]["metadata"]) == {}  # a flip: neither merged nor flagged
    assert got["m0"]["content"] == "tea house" and "m2" not in got  # merged into the first in store order
    assert not json.loads(got["m3"]["metadata"]) and got["m5"]["embedding"] is None
    assert json.loads(got["m4"]["metadata"]) == {"conflict_flagged": True}


def test_streaming_ingest(spark, tmp_path):
    from quarrywell.sources.table import MemoryTable
    from quarrywell.streaming.ingest import ingest

    rows = spark.createDataFrame([("m1", "u", "abc", [1.0, 0.0], 2, T0, T0, "user_stated", 0.5, "active", "{}", [], 1), ("m2", "u", "xyz", [0.0, 1.0], 2, T0, T0, "user_stated", 0.5, "active", "{}", [], 2)], RECORD)
    rows.write.parquet(f"{tmp_path}/in")
    table = MemoryTable(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        ingest(spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in"), table, "2024-02-02 00:00:00", f"{tmp_path}/ck").awaitTermination(120)
    assert table.get_all().count() == 2


def test_cli(memory, capsys):
    import sys

    from quarrywell import cli

    memory.remember("u", "abc")
    for args in (["list", "u"], ["recall", "u", "abc"], ["list-users"], ["stats"], ["forget", "u", "--yes"]):
        assert cli.run(cli.parser().parse_args(["--path", "x", *args]), memory, out=sys.stdout) == 0
    assert "abc" in capsys.readouterr().out


def _opposite(a, b):
    """Whether two texts share a key word and say the opposite, by plain loops."""
    from quarrywell.functions.text import NEGATIONS, OPPOSITES, PREPOSITIONS, PUNCTUATION

    def keys(words):
        out, before = set(), None  # before: whether the word before was taken as a preposition
        for w in words:
            taken = before is False and w in PREPOSITIONS
            if taken or len(w.strip(PUNCTUATION)) > 2:
                out.add(w.strip(PUNCTUATION))
            before = taken
        return out

    x, y = a.lower().split(), b.lower().split()
    if not keys(x) & keys(y):
        return False
    negated = [any(w in NEGATIONS for w in t) for t in (x, y)]
    return negated[0] != negated[1] or any((p in x and n in y) or (n in x and p in y) for p, n in OPPOSITES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_fold_of_many_writes_by_brute_force(spark):
    from quarrywell.plans import queries

    sf = "/root/testdata/sf0.001"
    stores, expected = {}, {}
    rows = sorted((r.asDict() for r in queries.mem(spark, sf).collect()), key=lambda r: r["seq"])
    ncos = lambda a, b: (float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) + 1) / 2
    for r in rows:
        r["v"] = np.array(r["embedding"], float)
        if r["seq"] % 2 == 0 and r["lifecycle_state"] != "deleted":
            stores.setdefault(r["user_id"], []).append(r)
    for r in (r for r in rows if r["seq"] % 2):
        store = stores.setdefault(r["user_id"], [])
        near = [ncos(r["v"], o["v"]) for o in store]
        same = next((o for o, n in zip(store, near) if n > 0.62 and not _opposite(r["content"], o["content"])), None)
        if same is not None:
            same["content"] = r["content"]
        else:
            if any(0.55 < n < 0.62 for n in near):
                r["metadata"] = json.dumps(json.loads(r["metadata"]) | {"conflict_flagged": True})
            store.append(r)
            same = r
        expected[same["memory_id"]] = same
    got = {r["memory_id"]: r for r in queries.QUERIES["q45_remember_many"](spark, sf).collect()}
    assert set(got) == set(expected) and any("conflict_flagged" in r["metadata"] for r in got.values())
    for k, r in got.items():
        e = expected[k]
        assert (r["user_id"], r["content"], r["lifecycle_state"], r["seq"]) == (e["user_id"], e["content"], e["lifecycle_state"], e["seq"])
        assert json.loads(r["metadata"]) == json.loads(e["metadata"])
