"""Near pairs and the fold of any user against plain loops; what the pivots save; what a micro-batch reads."""

import json
import random
from datetime import datetime, timezone

import numpy as np
import pytest

from quarrywell.operators import dedup, nearness
from quarrywell.schema import RECORD

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


def row(k, user, content, v, seq=None, state="active"):
    return (f"m{k}", user, content, None if v is None else [float(x) for x in v], 2, T0, T0, "user_stated", 0.5, state, '{"a":1}', [f"t{k}"], k if seq is None else seq)


def ncos(a, b):
    a, b = (np.asarray(np.asarray(x, np.float32), float) for x in (a, b))
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    cos = float(a @ b) / size if size > 0 and np.isfinite(size) else 0.0
    return (0.0 if np.isnan(cos) else cos) / 2 + 0.5


def pairs(new, old, low, high, before):
    out = set()
    for a in new:
        for b in old:
            if a[1] != b[1] or a[3] is None or b[3] is None or len(a[3]) != len(b[3]) or (before and not (b[12], b[0]) < (a[12], a[0])):
                continue
            if ncos(a[3], b[3]) > low and (high is None or ncos(a[3], b[3]) < high):
                out.add((a[0], b[0]))
    return out


def vectors(n, dim, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    return [centre[rng.integers(0, 5)] + spread * rng.normal(size=dim) for _ in range(n)]


@pytest.mark.parametrize("block,grid", [(512, 1 << 14), (7, 1)])
def test_near_pairs(spark, monkeypatch, block, grid):
    monkeypatch.setattr(nearness, "BLOCK", block)
    monkeypatch.setattr(nearness, "GRID", grid)
    nan = float("nan")
    odd = [None, [], [0.0] * 6, [nan] + [1.0] * 5, [1.0] * 6, [1.0] * 6, [2.0] * 6, [-1.0] * 6, [1.0] * 5, [float("inf")] + [0.0] * 5]
    rows = [row(k, f"u{k % 3 if k % 2 else 0}", "x", v) for k, v in enumerate([*vectors(150, 6, 1), *odd])] + [row(900, None, "x", [1.0] * 6)]
    new, old = rows[60:], rows[:120] + rows[-1:]
    frames = [spark.createDataFrame(x, RECORD) for x in (new, old)]
    known = [r for r in rows if r[1] is not None]
    for low, high, before in ((0.85, None, False), (0.65, 0.85, False), (0.7, None, True), (0.4, None, False), (0.4, 0.6, True)):
        want = pairs([r for r in new if r in known], [r for r in old if r in known], low, high, before)
        got = [(r["new_id"], r["old_id"]) for r in nearness.near_pairs(*frames, low, high, before).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        assert {r[0] for r in nearness.near_ids(*frames, low, high, before).collect()} == {a for a, _ in want}
    one = frames[1]
    assert {(r["new_id"], r["old_id"]) for r in nearness.near_pairs(one, one, 0.85, None, True).collect()} == pairs([r for r in old if r in known], [r for r in old if r in known], 0.85, None, True)
    none = spark.createDataFrame([], RECORD)
    assert nearness.near_pairs(none, one, 0.5).count() == nearness.near_pairs(one, none, 0.5).count() == nearness.near_ids(none, none, 0.5).count() == 0


def test_edges_are_strict(spark):
    """At a threshold exactly: not above it, not below it."""
    a, b = [3.0, 4.0], [4.0, 3.0]
    new, old = (spark.createDataFrame([row(k, "u", "x", v)], RECORD) for k, v in ((1, a), (2, b)))
    at = (24.0 / (5.0 * 5.0) + 1.0) / 2.0
    assert nearness.near_pairs(new, old, at).count() == 0 and nearness.near_pairs(new, old, 0.5, at).count() == 0
    assert nearness.near_pairs(new, old, at - 1e-15).count() == 1 and nearness.near_pairs(new, old, 0.5, at + 1e-15).count() == 1


def test_pivots_save_most_of_the_work(spark, monkeypatch):
    monkeypatch.setattr(nearness, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    rows = spark.createDataFrame([row(k, "u", "x", centre[k % 40] + 0.02 * rng.normal(size=16)) for k in range(1600)], RECORD)
    done, every = nearness.compared(rows, rows, 0.95)
    assert every == 1600 * 1600 and done < every / 5


def test_linked(spark):
    r = random.Random(6)
    edges = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(110)] + [("n1", "n1")] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    scratch = []
    got = {x["node"]: x["root"] for x in nearness.linked(spark.createDataFrame(edges, "u string, v string"), scratch).collect()}
    assert got == {n: min(m for m in root if find(m) == find(n)) for n in root} and scratch


WORDS = ["coffee", "love", "hate", "not", "tea", "never", "house", "like", "dislike", "river"]


def fold_rows(seed, users=2, n=120):
    r = random.Random(seed)
    v = vectors(n, 4, seed, 0.6)
    said = lambda: " ".join(r.choice(WORDS) for _ in range(4))
    rows = [row(k, f"u{r.randrange(users)}", said(), v[k] if r.random() > 0.05 else None) for k in range(n)]
    rows += [row(1000 + k, "u0", said(), v[0]) for k in range(15)] + [row(2000, "u0", "x", [0.0] * 4), row(2001, "u9", "alone", [1.0, 0, 0, 0])]
    r.shuffle(rows)
    old, new = rows[: len(rows) // 3], rows[len(rows) // 3 :]
    old = [(*x[:9], r.choice(["active", "archived", "deleted"]), *x[10:]) for x in old]
    return new, old


def folded_by_hand(new, old, threshold, low):
    out = {}
    for user in {r[1] for r in new}:
        store = [dict(zip(RECORD.fieldNames(), r)) | {"sources": []} for r in sorted(old, key=lambda r: (r[12], r[0])) if r[1] == user and r[9] != "deleted"]
        for r in sorted((r for r in new if r[1] == user), key=lambda r: (r[12], r[0])):
            r = dict(zip(RECORD.fieldNames(), r))
            near = [ncos(r["embedding"], o["embedding"]) if r["embedding"] is not None and o["embedding"] is not None else None for o in store]
            at = next((o for o, s in zip(store, near) if s is not None and s > threshold and not dedup._python_flip(r["content"], o["content"])), None)
            if at is not None:
                at |= {"content": r["content"], "tags": r["tags"]}
                at["sources"].append(r["memory_id"])
                out[at["memory_id"]] = at
                continue
            meta = json.loads(r["metadata"]) | ({"conflict_flagged": True} if any(s is not None and low < s < threshold for s in near) else {})
            store.append(r | {"metadata": meta, "sources": [r["memory_id"]]})
            out[r["memory_id"]] = store[-1]
    plain = lambda m: json.dumps(m if isinstance(m, dict) else json.loads(m), sort_keys=True)
    return {k: (v["user_id"], v["content"], v["tags"], plain(v["metadata"]), v["lifecycle_state"], v["seq"], sorted(v["sources"])) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_of_any_user(spark, seed):
    """All users in one task each, all spread out, and some each way: as the loop does."""
    new, old = fold_rows(seed)
    want = folded_by_hand(new, old, 0.85, 0.65)
    frames = [spark.createDataFrame(x, RECORD) for x in (new, old)]
    for most in (10**6, 0, 40) if seed == 1 else (40,):
        scratch = []
        got = {r["memory_id"]: r for r in dedup.folded(*frames, "2024-02-02 00:00:00", 0.85, 0.65, most, scratch).collect()}
        told = {k: (r["user_id"], r["content"], r["tags"], json.dumps(json.loads(r["metadata"]), sort_keys=True), r["lifecycle_state"], r["seq"], sorted(r["sources"])) for k, r in got.items()}
        assert told == want
        stamped = {k for k, r in got.items() if r["last_accessed_at"].day == 2}
        assert stamped == {k for k, r in got.items() if set(r["sources"]) - {k}}
        assert bool(scratch) == (most < 10**6)


def test_a_hot_user_is_spread(spark, monkeypatch):
    """One user with all rows, two by two alike: groups of the fold are pairs, whatever the user's size."""
    monkeypatch.setattr(nearness, "BLOCK", 64)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 24))
    rows = spark.createDataFrame([row(k, "hot", f"text {k // 2}", v[k // 2]) for k in range(600)], RECORD)
    sizes, fates = [], dedup.linked
    monkeypatch.setattr(dedup, "linked", lambda edges, scratch: sizes.append(fates(edges, scratch)) or sizes[-1])
    out = dedup.folded(rows, spark.createDataFrame([], RECORD), "2024-02-02 00:00:00", 0.97, 0.96, 100).collect()
    assert {tuple(sorted(r["sources"])) for r in out} == {tuple(sorted((f"m{2 * k}", f"m{2 * k + 1}"))) for k in range(300)}
    assert sizes[0].groupBy("root").count().where("count <> 2").count() == 0


def test_a_batch_reads_its_users_only(spark, tmp_path, monkeypatch):
    from quarrywell.sources.table import MemoryTable
    from quarrywell.streaming import ingest

    table = MemoryTable(spark, f"file://{tmp_path}/t", buckets=16)
    table.store(spark.createDataFrame([row(k, f"u{k % 30}", f"word {k}", [1.0, float(k)]) for k in range(300)], RECORD))
    read = []
    fold = ingest.folded

    def noted(new, existing, *a, **k):
        read.append(({r["user_id"] for r in existing.select("user_id").distinct().collect()}, existing._jdf.queryExecution().sparkPlan().toString()))
        return fold(new, existing, *a, **k)

    monkeypatch.setattr(ingest, "folded", noted)
    monkeypatch.setattr(MemoryTable, "get_all", lambda *_: pytest.fail("reads the whole table"))
    batch = spark.createDataFrame([row(900, "u3", "new text", [-1.0, 0.3]), row(901, "u3", "new text", [-1.0, 0.3]), row(5, "u5", "came before", [1.0, 5.0])], RECORD)
    for _ in range(2):
        ingest.ingest_batch(batch, table, "2024-02-02 00:00:00")
    monkeypatch.undo()
    users, plan = read[0]
    assert users == {"u3", "u5"} and "user_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert table.get_all().count() == 301 and table.get("m900").count() == 1 and table.get("m901").count() == 0 and table.get("m5").first()["content"] == "word 5"


SAYINGS = ["i love red tea", "i hate red tea", "i never drink tea", "i drink green tea", "do not stop", "on to", "no no", "", "we always walk in town", "we never walk in town", "you can swim far", "you can't swim far"]


@pytest.mark.parametrize("common", [256, 64])
def test_first_duplicates_without_pairs(spark, monkeypatch, common):
    """The first duplicate of each row, found without writing out the pairs of rows alike; texts that say the opposite are none."""
    monkeypatch.setattr(dedup, "COMMON", common)
    if common == 64:
        monkeypatch.setattr(dedup, "_common", lambda worded: ["swim"])  # nearly all pairs must be asked for their words
    rng = random.Random(5)
    rows = [row(k, "u", rng.choice(SAYINGS), v, seq=rng.choice([k, k, k // 7, None])) for k, v in enumerate([[1.0, 0.0]] * 300 + [[0.0, 1.0]] * 200)] + [row(900, "u", None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, RECORD)
    place = lambda r: (r[12] is None, r[12] or 0, r[0])
    said = [r for r in rows if r[2] is not None]
    every = {(a[0], b[0]) for a in said for b in said if a[3] == b[3] and place(b) < place(a) and not dedup._python_flip(a[2], b[2])}
    assert {(r["new_id"], r["old_id"]) for r in dedup.duplicates(df, df, 0.85, before=True).collect()} == every
    where = {r[0]: place(r) for r in rows}
    want = {}
    for a, b in every:
        want[a] = min(want.get(a, b), b, key=where.get)
    found = dedup.duplicates(df, df, 0.85, before=True, first=True)
    assert {r["new_id"]: r["old_id"] for r in dedup.first_duplicates(found).collect()} == want
    if common == 256:
        assert found.count() < 3 * len(rows) < len(every) / 20


def test_groups_of_the_fold_by_bytes(spark, monkeypatch):
    """Few users with long texts are not dealt to as few groups as there are shuffle partitions; a user of very long texts is folded apart."""
    seen = {}
    monkeypatch.setattr(dedup, "_folded_alone", lambda new, live, now, threshold, low, groups: seen.setdefault("groups", groups) and new)
    monkeypatch.setattr(dedup, "folded_apart", lambda new, live, *rest: seen.setdefault("apart", {r["user_id"] for r in new.select("user_id").collect()}) and new)
    rows = [row(k, f"u{k}", "word " * 200_000, [1.0, 0.0]) for k in range(40)]
    new, none = spark.createDataFrame(rows, RECORD), spark.createDataFrame([], RECORD)
    dedup.folded(new, none, T0)
    assert seen.pop("groups") >= 9 and "apart" not in seen
    monkeypatch.setattr(dedup, "MOST_BYTES", 1_500_000)
    dedup.folded(new.unionAll(spark.createDataFrame([row(99, "u7", "word " * 200_000, [1.0, 0.0])], RECORD)), none, T0)
    assert seen["apart"] == {"u7"}


def test_pairs_of_blocks_come_in_short_batches(spark):
    spark.conf.unset(nearness._BATCH)
    df = spark.createDataFrame([row(k, "u", "x", [1.0, k]) for k in range(20)], RECORD)
    nearness._sides(df, df, [])
    assert int(spark.conf.get(nearness._BATCH)) <= 4 << 20


def test_a_vector_is_sent_for_a_bundle_not_a_block(spark, monkeypatch):
    """100 blocks of one user in directions without structure: all pairs of blocks are compared, and each vector is sent a few times."""
    monkeypatch.setattr(nearness, "BLOCK", 16)
    v = np.random.default_rng(7).normal(size=(1600, 24))
    rows = spark.createDataFrame([row(k, "u", "x", v[k]) for k in range(1600)], RECORD)
    left, right = nearness._sides(rows, rows, [])
    sent = nearness._met(left, right, 0.6, True).selectExpr("sum(length(a_vs) + length(b_vs))").first()[0]
    assert sent <= 4 * 1600 * 24 * 8


def test_pairs_of_bundles(spark, monkeypatch):
    """Many bundles of many blocks, each two of them met once for both ways; rows alike, null places, and vectors kept as doubles."""
    for name, to in (("BLOCK", 7), ("BUNDLE", 30), ("LEAST", 10)):
        monkeypatch.setattr(nearness, name, to)
    r = random.Random(8)
    rows = [row(k, f"u{k % 5 // 4}", r.choice(SAYINGS), v) for k, v in enumerate([*vectors(160, 6, 3), *[[1.0] * 6] * 40])]
    rows = [(*x[:12], None if r.random() < 0.2 else r.randrange(90)) for x in rows]
    place = lambda x: (x[12] is None, x[12] or 0, x[0])
    near = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and ncos(a[3], b[3]) > 0.8 and place(b) < place(a)}
    df = spark.createDataFrame(rows, RECORD)
    left, right = nearness._sides(df, df, [])
    met = nearness._met(left, right, 0.8, True).select("a", "b").collect()
    assert left.count() > 6 and len(met) == len({frozenset(p) for p in met})
    for old in (df, df.select("*"), df.withColumn("embedding", df.embedding.cast("array<double>"))):
        got = [(x["new_id"], x["old_id"]) for x in nearness.near_pairs(df, old, 0.8, before=True).collect()]
        assert len(got) == len(set(got)) and set(got) == near
    assert {x[0] for x in nearness.near_ids(df, df, 0.8, before=True).collect()} == {a for a, _ in near}
    said, where, want = {x[0]: x[2] for x in rows}, {x[0]: place(x) for x in rows}, {}
    for a, b in near:
        if not dedup._python_flip(said[a], said[b]):
            want[a] = min(want.get(a, b), b, key=where.get)
    assert {x["new_id"]: x["old_id"] for x in dedup.first_duplicates(dedup.duplicates(df, df, 0.8, before=True, first=True)).collect()} == want


def test_words_with_one_hash(spark, monkeypatch):
    """Pairs that say opposite things meet hashes of their words; where these are the same, the words themselves decide."""
    monkeypatch.setattr(dedup, "_common", lambda worded: ["swim"])
    monkeypatch.setattr(dedup.F, "hash", lambda *c: dedup.F.lit(1))
    rows = [row(k, "u", s, [1.0, 0.0]) for k, s in enumerate(SAYINGS * 2)]
    df = spark.createDataFrame(rows, RECORD)
    want = {(a[0], b[0]) for a in rows for b in rows if b[12] < a[12] and not dedup._python_flip(a[2], b[2])}
    scratch = []
    assert {(r["new_id"], r["old_id"]) for r in dedup.duplicates(df, df, 0.85, before=True, scratch=scratch).collect()} == want
    asked = spark.read.parquet(next(p for p in scratch if "near-asked" in p))
    assert 0 < asked.count() < len(want) and "words" not in asked.columns
