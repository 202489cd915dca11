"""Quality rules: decision lists learned by sequential covering, applied as ordered conditional expressions.

Statistics of each whole text come from DataFrame functions alone.  They are written once; joined with the labels,
each statistic is cut into ``BINS`` quantile bins, and every step of the learner is one small aggregation over all
labelled rows: counts by (statistic, bin) among the rows that the rule covers so far and no earlier rule has.

Growing adds the threshold condition with the highest FOIL gain on two thirds of the labelled rows; pruning cuts a
rule back to the prefix with the best (bad - good) / (bad + good) on the other third; a rule stays only if at least
``PRECISION`` of what it covers there is labelled bad and its Wilson lower bound is at least ``FLOOR``.  So good
documents are kept even where that means keeping some bad ones.  Learning ends with the first rule that fails.

Defined results: a null text has no words; words are separated by space and U+0009 to U+000D; an empty table or one
without labels gives the base rules alone; equal rows get equal results; a null id has no label; labels of one id are
added up; other columns are ignored (``keep_good`` returns them all).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import dropped, table, written

BINS, RULES, CONDITIONS, PRECISION, FLOOR, SUPPORT = 24, 8, 4, 0.97, 0.85, 20
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "line_words"]


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of each whole text, with native functions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    a = docs.select(*keep, text.alias("t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("words"))
    a = a.select(*keep, "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"))
    hashes = F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, CAST(n_words AS int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END")
    a = a.select(*keep, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), hashes.alias("h"))
    a = a.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))) END")).drop("h")
    # Windows that are found twice stand side by side once sorted.
    a = a.withColumn("at", F.expr("sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))")).drop("s")
    covered = F.expr("aggregate(at, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + (i + 3 - greatest(i, a.end)), 'end', i + 3), a -> a.n)")
    return a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def rates(stats: DataFrame) -> DataFrame:
    """The statistics that rules speak of, as doubles; 0 where nothing is divided."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumns({
        "r_n_words": F.col("n_words").cast("double"), "r_word_length": over("word_chars", "n_words"), "r_symbol_rate": over("n_symbols", "word_chars"), "r_dup_line_rate": over("n_dup_lines", "n_lines"),
        "r_repeat_rate": over("n_repeat_words", "n_words"), "r_distinct_rate": over("n_distinct", "n_words"), "r_line_words": over("n_words", "n_lines"),
    })


@dataclass(frozen=True)
class Condition:
    """``name`` above (or at most) ``value``."""

    name: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(f"r_{self.name}")
        return c > self.value if self.above else c <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _wilson(bad: float, n: float, z: float = 1.645) -> float:
    p = bad / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """An ordered list of rules for bad documents, from statistics with rates and labels (doc_id, quality)."""
    by_id = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("good"))
    names = [f"r_{n}" for n in RATES]
    rows = stats.select("doc_id", *names).join(by_id, "doc_id")
    labelled = written(rows.select(*names, "bad", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")), "labelled")
    points = [k / BINS for k in range(1, BINS)]
    found = labelled.agg(*(F.percentile_approx(n, F.array(*map(F.lit, points)), F.lit(10_000)).alias(n) for n in names)).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    if not any(cuts.values()):
        dropped(labelled)
        return []
    # How many cuts lie below a value, by a short expression: a condition for each cut would be a method too long to compile well.
    below = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])).cast("array<double>"), lambda v: F.col(n) > v))
    bins = F.array(*(F.struct(F.lit(k).alias("f"), below(n).alias("b")) for k, n in enumerate(names)))
    rows = written(labelled.withColumn("bins", bins), "binned")
    dropped(labelled)
    rules: list[list[Condition]] = []
    left = F.lit(True)
    while len(rules) < RULES:
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            here = rows.where(left & F.col("grow") & _all(rule))
            table = here.select("bad", "good", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # len(RATES) * BINS rows at most
            best = _best(table, names, cuts)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        held = rows.where(left & ~F.col("grow"))
        upto = [[F.sum(F.when(_all(rule[: k + 1]), F.col(c)).otherwise(0)) for c in ("bad", "good")] for k in range(len(rule))]
        sums = [float(v or 0) for v in held.agg(*(c for pair in upto for c in pair)).first()]
        scores = [(b - g) / (b + g) if b + g else -1.0 for b, g in zip(sums[::2], sums[1::2])]
        size = max(range(len(rule)), key=lambda k: (scores[k], -k)) + 1
        bad, good = sums[2 * size - 2], sums[2 * size - 1]
        if bad + good < SUPPORT / 2 or bad < PRECISION * (bad + good) or _wilson(bad, bad + good) < FLOOR:
            break
        rules.append(rule[:size])
        left = left & ~_all(rules[-1])
    dropped(rows)
    return rules


def _best(counts: list, names: list[str], cuts: dict[str, list[float]]) -> tuple[Condition, float] | None:
    """The condition of the highest FOIL gain and how many good rows it leaves."""
    total_bad = sum(r["bad"] for r in counts if r["f"] == 0)
    total_good = sum(r["good"] for r in counts if r["f"] == 0)
    if not total_bad or not total_good:
        return None
    base, best = math.log2(total_bad / (total_bad + total_good)), (1e-9, None, 0.0)
    for f, name in enumerate(names):
        by_bin = {r["b"]: (r["bad"], r["good"]) for r in counts if r["f"] == f}
        bad = good = 0
        for b, value in enumerate(cuts[name]):
            x, y = by_bin.get(b, (0, 0))
            bad, good = bad + x, good + y
            for above, p, n in ((False, bad, good), (True, total_bad - bad, total_good - good)):
                if p and p + n >= SUPPORT:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > best[0]:
                        best = (gain, Condition(name[2:], above, float(value)), n)
    return None if best[1] is None else (best[1], best[2])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """Which rule rejects: 0 for the base rules, the place in the list from 1, null if none does."""
    out = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(_all(rule), F.lit(k))
    return out


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Condition]]]:
    """Statistics and verdict of every row of docs, and the rules."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = rates(written(text_statistics(source, ["doc_id"]), "statistics"))
    rules = learn(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    return stats.withColumn("rule", verdict(rules)), rules


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, rules = judged(docs, labels)
    said = F.when(F.col("rule") == 0, F.lit("base"))
    for k, rule in enumerate(rules, 1):
        said = said.when(F.col("rule") == k, F.lit(" and ".join(map(str, rule))))
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), F.col("rule").isNull().alias("kept"), said.alias("rejected_by"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    The rows are written with their statistics: these are computed once, and the rules, which name them often, are no
    filter that could be pushed into their expressions."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("qw_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = rates(written(text_statistics(rows, ["doc_id", "qw_row"]), "statistics"))
    rules = learn(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    return stats.where(verdict(rules).isNull()).select("qw_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
