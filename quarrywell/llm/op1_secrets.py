"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Both models are first-order chains over ``STATES`` character classes, trained from labelled samples: random strings
(hexadecimal, base 64 and alphanumeric renderings of digests) and ordinary identifiers (every word of the corpus as often
as it stands there, alone and joined in the usual styles).  A run of at least ``LEAST`` identifier characters is a secret if its log-likelihood ratio
is at least ``EVIDENCE`` in all and ``RATE`` a character.  Training counts the words of all documents, then the bigrams of
the distinct ones, weighted; what reaches the driver is one count for each pair of states.  A pair that was never seen
counts as one in ``UNSEEN``, whatever the size of the corpus.  The ratios are a literal array in the scan's expression; the scan runs in the JVM.

Code-point offsets come from splitting the text at its matches: lengths of pieces and matches add up.  Running sums are taken in blocks,
texts cut from chunks, and overlaps found in sorted order, so a text with very many matches costs little more than they do.

Defined results: null and empty texts have no spans; equal rows are all reported; a null id is kept; over an empty
table the identifiers' model is its prior; a text of any length is scanned whole; other columns are ignored
(``redacted`` returns them all).  Added spans never overlap base ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import table

LEAST, EVIDENCE, RATE, UNSEEN = 20, 12.0, 0.6, 3_000_000
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of one class: that the greedy run has at least so many characters is the same as matching only such runs.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
STATES = len(ALPHABET)
#: Elements of an array that are summed up at a time, and characters of a text that are cut from at a time: work for each match
#: grows with these, not with the text or its matches.
_BLOCK, _CHUNK = 256, 4096


def _escaped(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body, where name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, op: str) -> str:
    """SQL for the running sums (op ``+``) or maxima (op ``max``) of an array of ints, none below 0."""
    both = (lambda x, y: f"({x} + {y})") if op == "+" else (lambda x, y: f"greatest({x}, {y})")
    ints, start = "CAST(array() AS array<int>)", "named_struct('z', 0, 'o', CAST(array() AS array<int>))"
    step = lambda told, new: f"named_struct('z', {both('q.z', new)}, 'o', concat(q.o, array({told})))"
    within = f"transform(cut, part -> aggregate(part, {start}, (q, n) -> {step(both('q.z', 'n'), 'n')}, q -> q.o))"
    before = f"aggregate(inner_, {start}, (q, part) -> {step('q.z', 'part[size(part) - 1]')}, q -> q.o)"
    whole = _let("cut", f"transform(sequence(0, (size(all_) - 1) div {_BLOCK}), g -> slice(all_, g * {_BLOCK} + 1, {_BLOCK}))", _let("inner_", within, f"flatten(zip_with({before}, inner_, (z, part) -> transform(part, n -> {both('z', 'n')})))"))
    return _let("all_", values, f"CASE WHEN size(all_) = 0 THEN {ints} ELSE {whole} END")


def _found(pattern: str, kind: int, value_group: int = 0, least: int = 0, values: bool = False) -> Column:
    """Spans of all matches in ``t``: start, kind, end (and, asked for, the value)."""
    p = _escaped(pattern)
    told = f"named_struct('s', upto[i] - length(m[i]), 'k', {kind}, 'e', upto[i]" + (", 'v', m[i])" if values else ")")
    value = "m" if not value_group else f"regexp_extract_all(t, {p}, {value_group})"
    spans = _let("upto", _running("transform(m, (x, i) -> length(gap[i]) + length(x))", "+"), _let("val", value, f"transform(filter(sequence(0, size(m) - 1), i -> length(val[i]) >= {least}), i -> {told})"))
    none = "CAST(array() AS array<struct<s: int, k: int, e: int" + (", v: string" if values else "") + ">>)"
    return F.expr(f"CASE WHEN t RLIKE {p} THEN {_let('m', f'regexp_extract_all(t, {p}, 0)', _let('gap', f'split(t, {p}, -1)', spans))} ELSE {none} END")


def _states(text: str) -> str:
    """SQL for the states of a string's characters, from 1; 0 for any other character."""
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))"


def training_samples(docs: DataFrame) -> DataFrame:
    """label (random or ordinary), pair (of states: 256 times the one before, 0 at the front, and the next), n.

    The words of all documents are counted, then what a distinct word has: its pairs of letters, its first two letters, its
    first and last, and its last with its number.  The pairs of every style follow from sums of these."""
    seeds = docs.sparkSession.range(4096).select(F.sha2(F.col("id").cast("string"), 512).alias("d"))
    b64 = "base64(unhex(d))"
    random = seeds.select(F.explode(F.expr(f"array(substr(d, 1, 40), substr(replace(replace({b64}, '/', ''), '+', ''), 1, 40), substr({b64}, 1, 40), upper(substr(replace(replace({b64}, '/', ''), '+', ''), 41, 24)), replace(replace(substr({b64}, 30, 32), '/', '_'), '+', '-'))")).alias("v"))
    pairs = "transform(x, (b, i) -> (CASE WHEN i = 0 THEN 0 ELSE x[greatest(i - 1, 0)] END) * 256 + b)"
    random = random.select(F.expr(_states("v")).alias("x")).select(F.lit("random").alias("label"), F.explode(F.expr(pairs)).alias("pair"), F.lit(1).cast("long").alias("n"))
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), "[^A-Za-z]+")).alias("w")).where("length(w) >= 2").groupBy("w").agg(F.count("*").alias("n"))
    had = words.select("w", "n", F.expr(_states("w")).alias("x"))
    two = lambda what, x, y: f"named_struct('what', '{what}', 'x', {x}, 'y', {y})"
    had = had.select("n", F.explode(F.expr(f"""concat(transform(slice(x, 2, size(x)), (b, i) -> {two("inner", "x[i]", "b")}),
      array({two("head", "x[0]", "x[1]")}, {two("ends", "x[0]", "x[size(x) - 1]")}, {two("number", "x[size(x) - 1]", "CAST(pmod(xxhash64(w), 100) AS int)")}))""")).alias("f"))
    had = had.groupBy("f").agg(F.sum("n").alias("n")).select("f.*", "n")  # a few thousand rows
    return random.unionByName(had.select(F.lit("ordinary").alias("label"), F.explode(F.expr(_styled())).alias("p"), "n").select("label", F.col("p.pair").alias("pair"), (F.col("p.times") * F.col("n")).alias("n")))


def _styled() -> str:
    """SQL for the pairs, with how often each, that one feature (what, x, y) stands for in all styles together:
    w, w_w_w in lower case, w-w, wWW in camel case, w/w, W_W in upper case, and w with a number."""
    lower = lambda c: f"CASE WHEN {c} BETWEEN 27 AND 52 THEN {c} - 26 ELSE {c} END"
    upper = lambda c: f"CASE WHEN {c} BETWEEN 1 AND 26 THEN {c} + 26 ELSE {c} END"
    at = lambda c: ALPHABET.index(c) + 1
    pair = lambda x, y, times: f"named_struct('pair', ({x}) * 256 + ({y}), 'times', {times})"
    digit = lambda c: f"({c}) + {at('0')}"
    x, y, lx, ly, ux, uy = "x", "y", lower("x"), lower("y"), upper("x"), upper("y")
    inner = [pair(x, y, 6), pair(lx, ly, 6), pair(ux, uy, 2)]  # 1 + 2 + 2 + 1 times as it stands; 3 and all of camel case lower
    head = [pair(lx, ly, -2), pair(ux, ly, 2)]  # two of camel case's three begin in upper case
    ends = [
        pair("0", x, 4), pair("0", lx, 2), pair("0", ux, 1), pair(ly, at("_"), 2), pair(at("_"), lx, 2), pair(y, at("-"), 1), pair(at("-"), x, 1), pair(ly, ux, 2),
        pair(y, at("/"), 1), pair(at("/"), x, 1), pair(uy, at("_"), 1), pair(at("_"), ux, 1),
    ]
    one, more = pair(x, digit("y"), 1), [pair(x, digit("y div 10"), 1), pair(digit("y div 10"), digit("y % 10"), 1)]
    array = lambda rows: f"array({', '.join(rows)})"
    return f"CASE what WHEN 'inner' THEN {array(inner)} WHEN 'head' THEN {array(head)} WHEN 'ends' THEN {array(ends)} ELSE CASE WHEN y < 10 THEN {array([one])} ELSE {array(more)} END END"


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair of states (row: the state before, 0 at the front)."""
    counts = samples.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # one row for each label and pair of states at most
    size, n = STATES + 1, {}
    for label in ("random", "ordinary"):
        own = [r for r in counts if r["label"] == label]
        prior = max(1.0, sum(r["n"] for r in own) / UNSEEN)
        n[label] = [[prior] * size for _ in range(size)]
        for r in own:
            n[label][r["pair"] // 256][r["pair"] % 256] += r["n"]
    return [math.log(n["random"][a][b] / sum(n["random"][a])) - math.log(n["ordinary"][a][b] / sum(n["ordinary"][a])) for a in range(size) for b in range(size)]


def _likely(ratios: list[float]) -> Column:
    """The spans among ``runs`` that the models call random, none overlapping ``base``."""
    weights = "CAST(split('" + ",".join(f"{r:.5f}" for r in ratios) + "', ',') AS array<double>)"
    score = f"aggregate({_states('r.v')}, named_struct('p', 0, 'z', 0D), (a, b) -> named_struct('p', b, 'z', a.z + {weights}[a.p * {STATES + 1} + b]), a -> a.z)"
    random = f"transform(filter(runs, r -> {score} >= greatest({EVIDENCE}D, {RATE}D * length(r.v))), r -> named_struct('s', r.s, 'k', r.k, 'e', r.e))"
    # Each run's end among the starts of base spans; a run overlaps one if any that starts before its end ends after its start.
    marks = "array_sort(concat(transform(base, b -> named_struct('at', b.s, 'run', 0, 'e', b.e, 'i', -1)), transform(rand, (r, i) -> named_struct('at', r.e, 'run', -1, 'e', 0, 'i', i))))"
    free = f"transform(filter(sequence(0, size(marks) - 1), j -> marks[j].i >= 0 AND far[j] <= rand[greatest(marks[j].i, 0)].s), j -> rand[marks[j].i])"
    apart = _let("marks", marks, _let("far", _running("transform(marks, x -> x.e)", "max"), free))
    return F.expr(f"CASE WHEN size(runs) > 0 THEN {_let('rand', random, f'CASE WHEN size(rand) = 0 OR size(base) = 0 THEN rand ELSE {apart} END')} ELSE CAST(array() AS array<struct<s: int, k: int, e: int>>) END")


def _scanned(rows: DataFrame, ratios: list[float], keep: list[str]) -> DataFrame:
    """``keep``, t, and sorted ``base`` and ``added`` spans."""
    base = F.sort_array(F.concat(_found(ASSIGN, 0, 2, 6), _found(ACCESS, 1), _found(HEX, 2)))
    out = rows.select(*keep, "t", base.alias("base"), _found(RUN, 3, values=True).alias("runs"))
    return out.select(*keep, "t", "base", _likely(ratios).alias("added"))


_JOINED = "concat_ws(',', transform({0}, x -> concat_ws(':', element_at(array('assign', 'access', 'hex', 'markov'), x.k + 1), x.s, x.e)))"


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, one row for each of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return _scanned(rows, ratios, ["doc_id"]).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(F.expr(_JOINED.format("base")), 256).alias("base_sha256"),
        F.expr(_JOINED.format("sort_array(concat(base, added))")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with all their columns, each secret in text replaced by ``mark``."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("qw_row"), F.col("text").cast("string").alias("t"))
    # A mark stands where a span starts that no earlier one reaches; before it, the text from the farthest end so far.
    part = lambda x, y: f"""CASE WHEN ({x}) div {_CHUNK} = ({y}) div {_CHUNK} THEN substr(coalesce(get(chunk, ({x}) div {_CHUNK}), ''), ({x}) % {_CHUNK} + 1, ({y}) - ({x}))
      ELSE concat(substr(chunk[({x}) div {_CHUNK}], ({x}) % {_CHUNK} + 1), array_join(slice(chunk, ({x}) div {_CHUNK} + 2, ({y}) div {_CHUNK} - ({x}) div {_CHUNK} - 1), ''), substr(coalesce(get(chunk, ({y}) div {_CHUNK}), ''), 1, ({y}) % {_CHUNK})) END"""  # noqa: E731
    far = "CASE WHEN i = 0 THEN 0 ELSE upto[greatest(i - 1, 0)] END"
    pieces = f"concat(transform(filter(sequence(0, size(spans) - 1), i -> spans[i].s >= {far}), i -> {_let('a', far, part('a', 'spans[i].s'))}), array({_let('a', 'upto[size(upto) - 1]', part('a', 'length(t)'))}))"
    masked = _let("spans", "array_sort(concat(base, added))", _let("chunk", f"regexp_extract_all(t, '(?s).{{1,{_CHUNK}}}', 0)", _let("upto", _running("transform(spans, x -> x.e)", "max"), f"array_join({pieces}, {_escaped(mark)})")))
    new = F.expr(f"CASE WHEN size(base) + size(added) > 0 THEN {masked} ELSE t END")
    return _scanned(rows, ratios, ["qw_row"]).select("qw_row", new.alias("qw_text")).select(*(F.col("qw_text").alias("text") if n == "text" else F.col(f"qw_row.`{n}`") for n in names))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(training_samples(docs)))
