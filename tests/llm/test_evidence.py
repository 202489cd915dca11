"""Independent models: near-dedup on a whole table by brute force, decision lists by a plain learner, what the grid join passes over."""

from __future__ import annotations

import math
import os
import random
import re

import numpy as np
import pytest

from quarrywell.llm import op6_minhash_forest as o6
from quarrywell.llm import op9_quality_rules as o9
from quarrywell.llm import op10_epsilon_grid as o10
from quarrywell.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("words", [4, 5])
def test_op6_finds_every_link_of_a_table(spark, words):
    """All 1,000 documents: sets and groups are those of all pairs."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    ids, sets, known = [], [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        ids.append(i)
        sets.append({known.setdefault(g, len(known)) for g in grams})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = 0
    order = sorted(range(len(ids)), key=lambda k: len(sets[k]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if not sets[a] or 100 * len(sets[a]) < 80 * len(sets[b]):
                if sets[a]:
                    break
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in o6.near_groups(table(spark, SF, "documents"), words=words).collect()}
    assert links > 50
    assert got == {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def plain_rules(rows, growing):
    """The list that sequential covering learns from (id, rates, bad, good), by loops."""
    names, support = o9.RATES, o9.SUPPORT
    data = [(growing[i], r, b, g) for i, r, b, g in rows]
    cuts = []
    for f in range(len(names)):
        values = sorted(r[f] for _, r, _, _ in data)
        cuts.append(sorted({values[max(0, math.ceil(k / o9.BINS * len(values)) - 1)] for k in range(1, o9.BINS)}))
    holds = lambda c, r: (r[c[0]] > c[2]) == c[1]
    rules, left = [], data
    while len(rules) < o9.RULES:
        rule, here = [], [x for x in left if x[0]]
        while len(rule) < o9.CONDITIONS:
            p0, n0 = sum(x[2] for x in here), sum(x[3] for x in here)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in range(len(names)):
                for v in cuts[f]:
                    for above in (False, True):
                        some = [x for x in here if holds((f, above, v), x[1])]
                        p, n = sum(x[2] for x in some), sum(x[3] for x in some)
                        if p and p + n >= support:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, (f, above, v), n)
            if best[1] is None:
                break
            rule.append(best[1])
            here = [x for x in here if holds(best[1], x[1])]
            if best[2] == 0:
                break
        if not rule:
            break
        scores = []
        for k in range(1, len(rule) + 1):
            some = [x for x in left if not x[0] and all(holds(c, x[1]) for c in rule[:k])]
            p, n = sum(x[2] for x in some), sum(x[3] for x in some)
            scores.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        _, k, p, n = max(scores)
        if p + n < support / 2 or p < o9.PRECISION * (p + n) or o9._wilson(p, p + n) < o9.FLOOR:
            break
        rules.append(rule[:-k])
        left = [x for x in left if not all(holds(c, x[1]) for c in rules[-1])]
    return [[(names[f], above, v) for f, above, v in rule] for rule in rules]


def test_op9_learns_what_a_plain_learner_learns(spark):
    r, texts, labels = random.Random(17), [], []
    for k in range(900):
        kind = r.choice(["good", "good", "symbols", "lines", "short"])
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(55, 140))]
        if kind == "symbols":
            w = [x + "#" if r.random() < 0.4 else x for x in w]
        elif kind == "lines":
            w = [x for _ in range(6) for x in [*w[:12], "\n"]]
        elif kind == "short":
            w = [x[:2] for x in w]
        texts.append((k, " ".join(w)))
        labels.append((k, int((kind == "good") != (r.random() < 0.005))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    stats, rules = o9.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    growing = {x["id"]: x["g"] for x in spark.range(900).selectExpr("id", "pmod(xxhash64(id), 3) < 2 AS g").collect()}
    told = dict(labels)
    rows = [(x["doc_id"], [x[f"r_{n}"] for n in o9.RATES], int(told[x["doc_id"]] == 0), int(told[x["doc_id"]] == 1)) for x in stats.collect()]
    assert [[(c.name, c.above, c.value) for c in rule] for rule in rules] == plain_rules(rows, growing)
    assert len(rules) >= 2


def test_op10_passes_over_most_blocks(spark, monkeypatch):
    """Vectors in many directions of a few dimensions: pairs of blocks that are compared, of all pairs."""
    monkeypatch.setattr(o10, "BLOCK", 32)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 24))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    seen = []
    pairs = o10._block_pairs
    monkeypatch.setattr(o10, "_block_pairs", lambda boxes, n, eps: seen.append((n, (out := pairs(boxes, n, eps)).count())) or out)
    got = {r["vec_id"]: r["n_links"] for r in o10.near_vectors(rows).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist()))
    n, kept = seen[0]
    assert n >= 90 and kept < 0.5 * n * (n + 1) / 2
