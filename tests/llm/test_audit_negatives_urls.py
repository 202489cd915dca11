"""Filter audit, hard negatives and url rules against brute force on small tables with the odd cases, and against SQL."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywell.llm import op11_filter_audit as o11
from quarrywell.llm import op12_hard_negatives as o12
from quarrywell.llm import op13_url_rules as o13
from quarrywell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = duck().execute(ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())


# Filter audit


def texts():
    r = random.Random(4)
    some = ["alpha", "beta", "Gamma", "DELTA", "#x", "a|b", "eps\xa0ilon", "zeta"]
    plain = [" ".join(f"w{r.randint(0, 80)}" for _ in range(r.choice([10, 49, 50, 51, 90]))) for _ in range(40)]
    odd = [" ".join(r.choice(some) for _ in range(r.choice([3, 60]))) for _ in range(20)]
    return [*plain, *odd, "", None, "A" * 3, "Ab\n\x0bc\x1cd", plain[0], plain[0], plain[1] + " ", "x " * 30_000, None]


def audited(rows, labels):
    fails, smallest = [], {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = WORDS.findall(t)
        f = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > smallest[t],
        }
        fails.append((part or "", {k for k, v in f.items() if v}, i is not None and any(x[0] == i and x[1] == 1 for x in labels), i is not None and any(x[0] == i and x[2] == 1 for x in labels)))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, k in enumerate(order, 1):
                gone = [f for f in alive if k in f[1]]
                alive = [f for f in alive if k not in f[1]]
                shapley[k] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audit_rows():
    r = random.Random(9)
    rows = [(k * 3, t, r.choice(["s1", "s1", "s2", None, ""])) for k, t in enumerate(texts())]
    return [*rows, rows[0], rows[5], (None, rows[1][1], "s1"), (None, None, None), (7, "only row of its part", "s3")]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, 0, 1), (9, None, None), (None, 1, 1), (180, 1, 0), (183, 0, 1), (999, 1, 1)]


def test_audit(spark, audit_rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in audit_rows], "doc_id long, text string, source string, part int, kept int, A int")
    labels = spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, E int")
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in cols) for r in o11.audit(docs, labels).collect()}
    want = audited(audit_rows, LABELS)
    assert len(got) == len(want) == 600 * len({p for p, _, _ in want})
    assert got == want


def test_audit_states(spark, audit_rows):
    """32 nodes, 80 edges, and each edge's count is the difference of its nodes' documents."""
    rows = o11.failures(spark.createDataFrame(audit_rows, "doc_id long, text string, source string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    states = [r.asDict() for r in o11.walked(rows).collect()]
    assert {r["state"] for r in states} == set(range(32))
    kept = {(r["part"], r["state"]): r["kept"] for r in states}
    edges = 0
    for r in states:
        for k, e in enumerate(r["edges"]):
            if r["state"] >> k & 1:
                assert e["removed"] == 0
            else:
                edges += r["part"] == "s1"
                assert kept[r["part"], r["state"]] - e["removed"] == kept.get((r["part"], r["state"] | 1 << k), 0)
    assert edges == 80
    with pytest.raises(ValueError):
        o11.walked(rows, filters=tuple("ABCDEFGHI"))


def test_audit_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert o11.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "# x", None)], "doc_id long, text string, source string")
    assert o11.audit(one, labels).count() == 600


# Hard negatives


def mined(rows, every, n_pos=5, n_neg=3, low=50, high=95, scale=256):
    own = {}
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(scale * float(x)) for x in v)
        if sum(x * x for x in q) < 1 << 54:
            own[i, label, q] = None
    own = list(own)
    last = lambda i: (i is None, i or 0)
    out = []
    for a in own:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in own if len(r[2]) == len(a[2]) and r != a]
        scored.sort(key=lambda s: (-s[0], last(s[1][0])))
        for p, pos in [s for s in scored if s[1][1] == a[1]][:n_pos]:
            neg = [s for s in scored if s[1][1] != a[1] and low * p <= 100 * s[0] <= high * p][:n_neg]
            out += [(a[0], pos[0], k, r[0], p, s) for k, (s, r) in enumerate(neg, 1)]
    return Counter(out)


def vectors(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    return [(k, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centre[rng.integers(0, 6)] + spread * rng.normal(size=dim)]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, key int, row int")


@pytest.mark.parametrize("dim,blocks", [(12, (2048, 256)), (12, (16, 4)), (1, (8, 2)), (33, (32, 8))])
def test_negatives(spark, monkeypatch, dim, blocks):
    monkeypatch.setattr(o12, "ROWS", blocks[0])
    monkeypatch.setattr(o12, "ANCHORS", blocks[1])
    rows = vectors(300, dim, dim)
    got = Counter(tuple(r) for r in o12.mined(frame(spark, rows), 10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(rows, 10) and got


def test_negatives_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(o12, "ROWS", 32)
    monkeypatch.setattr(o12, "ANCHORS", 8)
    rows = vectors(120, 6, 3)
    v = rows[0][2]
    rows += [(k, 1, v) for k in range(200, 260)]  # more copies than an anchor has positives, anchors among them
    rows += [(k, 2, [0.8 * x for x in v]) for k in range(300, 330)]  # and more than it has negatives
    rows += [rows[10], rows[10], (10, 3, v), (10, rows[10][1], [x + 0.1 for x in v]), (20, None, v), (30, 1, None), (40, 1, [1.0] * 5 + [None]), (40, 1, [1.0] * 5 + [math.nan]), (40, 1, [math.inf] + [1.0] * 5), (50, 1, [1e300] * 6)]
    rows += [(None, 1, v), (None, 2, [0.7 * x for x in v]), (60, 1, []), (61, 1, []), (62, 2, []), (70, 1, [0.0] * 6), (80, 2, [1.0, 2.0]), (81, 2, [1.0, 2.5]), (82, 3, [0.9, 1.0]), (90, 1, [1000.0] * 6), (91, 1, [999.0] * 6), (92, 2, [500.5] * 6)]
    got = Counter(tuple(r) for r in o12.mined(frame(spark, rows), 10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = mined(rows, 10)
    assert got == want
    assert any(k[0] in range(200, 260) for k in got) and any(k[1] is None or k[3] is None for k in want) == any(k[1] is None or k[3] is None for k in got)


def test_negatives_drop_early():
    """Most pairs go before the last step, and none that counts."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64)) * np.geomspace(40, 0.5, 64)
    ints = np.floor(base[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64))).astype("<i2")
    turn = np.linalg.eigh(ints.T.astype(float) @ ints)[1][:, ::-1]
    side = lambda x: o12._Side(x.tobytes(), len(x), 64, turn)
    a, r = ints[:50], ints[50:]
    exact = a.astype(np.int64) @ r.T.astype(np.int64)
    low, high = np.full((50, 1), -np.inf), np.full((50, 1), np.inf)
    i, j, s = o12._scores(side(a), side(r), np.ones(exact.shape, bool), low, high, 5)
    assert (s == exact[i, j]).all() and len(i) < exact.size / 20
    for k in range(50):
        fifth = np.sort(exact[k])[-5]
        assert set(np.flatnonzero(exact[k] >= fifth)) <= set(j[i == k])


def test_negatives_empty(spark):
    assert o12.mined(frame(spark, [])).count() == 0
    assert o12.mined(frame(spark, [(50, 1, [1.0, 2.0])])).count() == 0


# Url rules


def judged(urls, rules, default="allow"):
    best_of = {}
    for host, path, verdict in rules:
        if host is not None:
            key = (re.sub("[A-Z]", lambda m: m[0].lower(), host), path or "")
            best_of[key] = max(verdict, best_of.get(key, ""))
    out = []
    for i, url in urls:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in best_of.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((i, host, path, *(max(fit)[2:] if fit else (None, default))))
    return Counter(out)


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://Www.Example.COM/en/1", "http://example.com", "http://example.com/", "http://example.com/en", "http://example.com/en/x?y=/fr/", "http://www.example.com/en/#top", "http://badexample.com/en/",
    "http://a.net/es/1", "http://net/es/1", "http://a.net?x=/es/", "http://a..b.com/", "http://.com/", "http://com./", "http://ünï.com/é/x", "http://x.com:80/en/", "http://x/http://example.com/en/", "a://b.com\n/c d", "http://example.com-x/", "http://example.com!/en/", "://com/",
    "http://long.com/" + "p/" * 3000, "http://a.b.c.d.e.f.g.com/q", "http://EXAMPLE.com/EN/",
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "k", 1) for r in rows], "page_id long, url string, host string, key string, range int")


def rules_frame(spark, rules):
    return spark.createDataFrame([(*r, 1) for r in rules], "host string, path string, verdict string, key int")


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_urls(spark, monkeypatch, ranges):
    monkeypatch.setattr(o13, "RANGES", ranges)
    r = random.Random(ranges)
    hosts = ["com", "example.com", "www.example.com", "a.net", "net", "b.a.net", "ex-ample.com", "example.community", "co.uk", "x.co.uk"]
    paths = ["/", "/en/", "/en/a", "/en/a/b", "/fr/", "", "/e", "/z" * 30]
    urls = [(k, f"http://{r.choice(['', 'm.', 'www.'])}{r.choice(hosts)}{r.choice(paths)}{r.randint(0, 9) if r.random() < 0.5 else ''}{r.choice(['', '?q', '#t'])}") for k in range(400)]
    urls += [(1000 + k, u) for k, u in enumerate(URLS)] + [(k, "http://hot.example.com/en/a") for k in range(2000, 2200)] + [(3, urls[3][1])] * 2 + [(None, "http://a.net/en/x"), (None, None)]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(40)] + [("Example.COM", "/EN/", "block"), (None, "/", "block"), ("co.uk", None, "block"), ("", "", "block"), ("hot.example.com", "/en/a", "allow"), ("hot.example.com", "/en/a", "block")]
    rules += [("hot.example.com", f"/p{k}", "block") for k in range(200)]
    for some, default in ((rules, "allow"), ([(h, p, v) for v, h, p in o13.RULES], "block"), ([], "allow")):
        got = o13.judged(pages(spark, urls), rules_frame(spark, some), default)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert Counter(tuple(x) for x in got.collect()) == judged(urls, some, default)


def test_urls_empty(spark):
    assert o13.judged(pages(spark, []), rules_frame(spark, [("com", "/", "block")])).count() == 0


def test_rule_goes_where_it_can_fit():
    at = ["com/a/#/b", "com/a/#/m", "com/a/#/t", "com/z/#/"]
    assert o13.met("com/", "/", at) == [0, 1, 2, 3, 4]
    assert o13.met("com/a/", "/p", at) == [0, 2, 3]
    assert o13.met("org/", "/", at) == [4]


def test_each_url_is_shuffled_once(spark):
    """One exchange of the urls, without html, and rules in the same one."""
    plan = o13.op13_url_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(range") == 1 and "html" not in plan


def test_hot_url_lies_in_several_ranges(spark):
    rows = pages(spark, [(k, "http://a.com/x") for k in range(2000)])
    at = o13.cuts(o13.keyed(rows), 8)
    assert len(at) == 7
    placed = o13._placed(o13.keyed(rows), o13.ruled(rules_frame(spark, [("com", "/", "block")])), at).groupBy("range").agg(F.count("page_id").alias("n"), F.count("rule").alias("rules")).collect()
    assert len(placed) == 8 and max(r["n"] for r in placed) < 1000 and all(r["rules"] == 1 for r in placed)
