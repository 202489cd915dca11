"""Vectors kept by content; the adapters of models that aren't here, over stub modules; nearest rows by bounds."""

import sys
import types
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pytest

from quarrywell.embedding import FunctionEmbedder, fast_embedder, openai_embedder
from quarrywell.engine import Memory
from quarrywell.schema import RECORD
from quarrywell.sources.vectors import VectorCache

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


class Counting:
    """Notes each text that it is asked for, in a file, wherever it runs."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    def asked(self):
        return sorted(Path(self.path).read_text().split("\n")[:-1]) if Path(self.path).exists() else []


@pytest.fixture()
def counting(tmp_path):
    return Counting(tmp_path / "asked.txt")


def test_each_text_is_asked_for_once(spark, tmp_path, counting):
    cache, embed = VectorCache(spark, f"file://{tmp_path}/v", "m"), FunctionEmbedder(counting, 2)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "a", None, "", "a"])], "k long, content string")
    got = lambda df: {r["k"]: r["embedding"] for r in cache.embedded(df, embed).collect()}
    want = {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [1.0, 1.0], 3: None, 4: [0.0, 1.0], 5: [1.0, 1.0]}
    assert got(rows) == want == got(rows) and counting.asked() == ["", "a", "bb"]
    assert got(spark.createDataFrame([(1, "ccc"), (2, "a")], "k long, content string")) == {1: [3.0, 1.0], 2: [1.0, 1.0]} and counting.asked() == ["", "a", "bb", "ccc"]
    cache.erase(spark.createDataFrame([("a",), ("never",), (None,)], "content string"))
    assert cache.stored().count() == 3 and got(rows) == want and counting.asked().count("a") == 2
    assert not VectorCache(spark, f"file://{tmp_path}/v", "other").stored().count()


def test_migrate_twice_asks_once(spark, tmp_path, counting):
    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(lambda ts: [[1.0, float(len(t))] for t in ts], 2), now=lambda: T0, vectors=f"file://{tmp_path}/v")
    memory.table.store(spark.createDataFrame([(f"m{k}", "u", f"text {k % 3}", [1.0, 1.0], 2, T0, T0, "user_stated", 0.5, "active", "{}", [], k) for k in range(9)], RECORD))
    new = FunctionEmbedder(counting, 2, "new")
    assert memory.migrate("u", new) == 9 and memory.migrate("u", new) == 9
    assert counting.asked() == ["text 0", "text 1", "text 2"]
    assert all(r["embedding"] == [6.0, 1.0] for r in memory.table.get_all().collect())
    assert memory.forget("u", "m0") == 1
    cache = VectorCache(spark, f"file://{tmp_path}/v", new.name())
    assert cache.stored().count() == 2
    assert memory.forget("u") == 8 and cache.stored().count() == 0


def test_remember_rows(spark, tmp_path, counting):
    memory = Memory(spark, f"file://{tmp_path}/t", FunctionEmbedder(counting, 2, "m"), now=lambda: T0, vectors=f"file://{tmp_path}/v")
    rows = spark.createDataFrame([("r1", "u", "abc", 7.0, ["x"]), ("r2", "u", "abc", 0.1, []), ("r3", "v", "abc", None, None)], "row string, user_id string, content string, importance double, tags array<string>")
    held = {r["row"]: r["memory_id"] for r in memory.remember_rows(rows).collect()}
    assert held["r1"] == held["r2"] != held["r3"] and counting.asked() == ["abc"]
    stored = {r["memory_id"]: r for r in memory.table.get_all().collect()}
    assert set(stored) == set(held.values()) and stored[held["r1"]]["importance"] == 1.0 and stored[held["r3"]]["tags"] == []
    bad = spark.createDataFrame([("u", " ")], "user_id string, content string")
    with pytest.raises(Exception, match="content must not be blank"):
        memory.remember_rows(bad)
    assert memory.table.get_all().count() == 2


def test_models_that_are_not_here(monkeypatch):
    """The adapters call what the packages offer."""
    fast, ai = types.ModuleType("fastembed"), types.ModuleType("openai")
    seen = []

    class TextEmbedding:
        def __init__(self, model):
            seen.append(model)

        def embed(self, texts):
            return (np.full(384, float(len(t))) for t in texts)

    class OpenAI:
        @property
        def embeddings(self):
            return self

        def create(self, model, input):
            seen.append(model)
            return types.SimpleNamespace(data=[types.SimpleNamespace(embedding=[float(len(t))] * 1536) for t in input])

    fast.TextEmbedding, ai.OpenAI = TextEmbedding, OpenAI
    monkeypatch.setitem(sys.modules, "fastembed", fast)
    monkeypatch.setitem(sys.modules, "openai", ai)
    for make, dim, model in ((fast_embedder, 384, "BAAI/bge-small-en-v1.5"), (openai_embedder, 1536, "text-embedding-3-small")):
        e = make()
        assert e.dimension() == dim and e.embed(["ab", "abc"]) == [[2.0] * dim, [3.0] * dim] and e.embed([]) == [] and e.embed_single("a") == [1.0] * dim and model in seen and model in e.name()


def test_nearest_scores_a_share(spark, monkeypatch):
    from quarrywell.operators import nearness
    from quarrywell.operators.nearest import Nearest

    monkeypatch.setattr(nearness, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 12))
    rows = [(f"m{k}", f"u{k % 2}", "x", (centre[k % 30] + 0.05 * rng.normal(size=12)).tolist(), 12, T0, T0, "user_stated", 0.5, "active", "{}", [], k) for k in range(1500)]
    rows += [(f"z{k}", "u0", "x", v, 12, T0, T0, "user_stated", 0.5, "active", "{}", [], 9000 + k) for k, v in enumerate([[0.0] * 12, None, [float("nan")] * 12, rows[0][3], rows[0][3]])]
    df = spark.createDataFrame(rows, RECORD)
    asked = [(q, f"u{q % 2}", (centre[q] + 0.05 * rng.normal(size=12)).tolist()) for q in range(20)] + [(50, "u0", rows[0][3]), (51, "nobody", rows[0][3]), (52, "u0", [0.0] * 12)]
    queries = spark.createDataFrame(asked, "query_id long, user_id string, embedding array<float>")
    index = Nearest(df)
    got = {}
    for r in index.topk(queries, 7).collect():
        got.setdefault(int(r["query_id"]), {})[r["pos"]] = (r["memory_id"], r["sim"])

    def sim(a, b):
        a, b = (np.asarray(np.asarray(x, np.float32), float) for x in (a, b))
        size = np.sqrt((a * a).sum() * (b * b).sum())
        return ((a * b).sum() / size + 1) / 2 if size > 0 and np.isfinite(size) else 0.5

    for q, user, v in asked:
        order = sorted(((-sim(v, r[3]), r[12], r[0]) for r in rows if r[1] == user and r[3] is not None))[:7]
        mine = got.get(q, {})
        assert [mine[p][1] for p in sorted(mine)] == pytest.approx([-s for s, _, _ in order], abs=1e-9)
        if q != 52 and order and -order[-1][0] - max([sim(v, r[3]) for r in rows if r[1] == user and r[3] is not None and r[0] not in {i for _, _, i in order}]) > 1e-9:
            assert {i for i, _ in mine.values()} == {i for _, _, i in order}
    assert index.share() < 0.5
