"""The pipeline's stages, each against a brute-force version on what its predecessor kept."""

from __future__ import annotations

import re

import pytest
from test_operators import PASSAGE, base_spans, crc, kept_words, near_brute, prose, statistics, words_of

from quarrywell.llm import op1_secrets, op7_packing
from quarrywell.llm.encoders import library

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def packed_brute(docs):
    """Pieces of all documents in id order, by the library's own ids."""
    lib, at, out = library(op7_packing.TOKENIZER), 0, []
    for doc_id, text in sorted(docs):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        s = 0
        while s < len(ids):
            n = min(len(ids) - s, op7_packing.WIDTH - at % op7_packing.WIDTH)
            out.append((doc_id, s, n, crc(ids[s : s + n]), len(ids), at // op7_packing.WIDTH, at % op7_packing.WIDTH))
            s, at = s + n, at + n
    return sorted(out)


def masked_brute(text, added):
    """The text with the spans of the plain patterns, and those that the models add, masked."""
    spans, out, at = sorted([(s, e) for s, _, e in base_spans(text)] + added), "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [prose(150, 50 + k) for k in range(30)]
    texts += [texts[3], texts[4] + " more words here", "too short", None, "", texts[5][:600] + " password: abcdefgh99 " + texts[6][:400], "x y z " * 100]
    texts += [f"{prose(90, 800 + k)} {PASSAGE} {prose(70, 820 + k)}" for k in range(3)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    held = {name: {r["doc_id"]: r["text"] for r in seen[name].select("doc_id", "text").collect()} for name, _ in pipeline.STAGES if name != "packing"}
    assert held["quality_rules"] == {r[0]: r[1] for r in rows if not statistics(r[1] or "")[-1]}
    groups = near_brute(sorted(held["quality_rules"].items()), words=5)
    assert held["near_dedup"] == {i: held["quality_rules"][i] for i, _, c in groups if i == c} and not {30, 31} & set(held["near_dedup"])
    repeats = kept_words(sorted(held["near_dedup"].items()))
    assert sorted((k, words_of(t)) for k, t in held["substring_dedup"].items()) == sorted(repeats)
    assert sum(len(words_of(held["near_dedup"][k])) - len(w) >= 70 for k, w in repeats if k >= 37) == 2  # the passage of the last three stays once
    source = spark.createDataFrame(sorted(held["substring_dedup"].items()), "doc_id long, text string")
    ratios = op1_secrets.train(op1_secrets.training_samples(source))
    added = {r["doc_id"]: [tuple(map(int, m)) for m in re.findall(r"markov:(\d+):(\d+)", r["spans"])] for r in op1_secrets.scan(source, ratios).collect()}
    assert held["secret_scan"] == {k: masked_brute(t, added[k]) for k, t in held["substring_dedup"].items()}
    assert any("[SECRET]" in t for t in held["secret_scan"].values())
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    expected = packed_brute(held["secret_scan"].items())
    assert sorted(tuple(r[c] for c in pieces) for r in seen["packing"].collect()) == expected
    assert sorted(tuple(r[c] for c in pieces) for r in pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_odd_tables(spark, tmp_path):
    """An empty table; nulls in every column, rows without ids, repeated rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    p = prose(150, 61)
    odd = [(None, None, None, None, None), (None, p, None, None, None), (7, p, "en", None, 1), (7, p, "en", None, 1), (8, "", "en", "s", 0), (9, prose(150, 62), None, "s", None)]
    for name, rows, kept in (("empty", [], []), ("odd", odd, [7, 7, 9])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = pipeline.run(spark, d).select("doc_id", "start").collect()
        assert sorted(r["doc_id"] for r in got if r["start"] == 0) == kept


def test_near_dedup_takes_five_words(spark):
    """A pair at 0.8 or more by four words, below it by five, stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{k}" for k in range(84)]
    other = [*words[:30], "x", *words[31:60], "y", *words[61:], "z"]
    share = lambda n: (lambda a, b: len(a & b) / len(a | b))(*({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (words, other)))
    assert share(4) >= 0.8 > share(5)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*words, "end"]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]
