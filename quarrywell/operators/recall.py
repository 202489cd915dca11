"""Recall: candidates by similarity, ranking, diversity re-ranking, token budget, for many queries at once.

``queries``: query_id, user_id, query, embedding.  ``memories``: rows of the memory table.  Everything partitions by
query_id after one join on user_id; after the candidate step a query holds over-fetched rows only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrywell.functions.scoring import HALF_LIFE_HOURS, bm25_single, bm25_term, classic_score, hybrid_score, recency
from quarrywell.functions.text import token_count, tokens
from quarrywell.functions.vector import cosine, ncos, norm, semantic
from quarrywell.schema import RECALLED

OVERFETCH, LAMBDA = 3, 0.7
#: Fixed value: the line above the memories of a context block.
PREFIX = "Relevant context from memory:"


def in_states(states: tuple[str, ...] | list[str] | None = None) -> Column:
    """None: the recalled states; an empty list: no rows."""
    states = RECALLED if states is None else states
    return F.col("lifecycle_state").isin(list(states)) if states else F.lit(False)


def dimension_guard(value: Column, expected: int | None) -> Column:
    """``value``, or a failure where the row's stored dimension is another one.  Part of the value itself, so no plan
    that needs the value can leave it out."""
    if expected is None:
        return value
    bad = F.col("embedding_dim").isNotNull() & (F.col("embedding_dim") != expected)
    told = F.concat(F.lit(f"dimension mismatch: expected {expected}, stored "), F.col("embedding_dim").cast("string"))
    return F.when(bad, F.raise_error(told).cast("double")).otherwise(value)


def candidates(queries: DataFrame, memories: DataFrame, k: int, states=None, dimension: int | None = None) -> DataFrame:
    """The k nearest rows of each query's user, with ``sim`` and ``pos``; ties by seq.  ``dimension``: the embedder's; a
    candidate of another one fails."""
    q = queries.select("query_id", F.col("user_id").alias("q_user"), "query", F.col("embedding").alias("q_emb"), norm("embedding").alias("q_norm"))
    m = memories.where(in_states(states) & F.col("embedding").isNotNull()).withColumn("m_norm", norm("embedding"))
    joined = m.join(q, m["user_id"] == q["q_user"]).drop("q_user")
    sim = dimension_guard(ncos("q_emb", "embedding", F.col("q_norm"), F.col("m_norm")), dimension)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "seq")
    return joined.withColumn("sim", sim).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).drop("q_norm", "m_norm")


def with_keywords(cand: DataFrame) -> DataFrame:
    """cand with ``keyword``: BM25 over each query's own candidates.  A window of over-fetched rows gathers how often each query word
    stands in each of them, so candidates are worked out once."""
    own = Window.partitionBy("query_id")
    a = cand.withColumns({"qw_d": tokens("content"), "qw_q": tokens("query")}).withColumns({"qw_terms": F.array_distinct("qw_q"), "qw_len": F.size("qw_d").cast("double")})
    a = a.withColumn("qw_tf", F.transform("qw_terms", lambda t: F.size(F.filter("qw_d", lambda x: x == t)).cast("double")))
    a = a.withColumns({"qw_n": F.count("*").over(own), "qw_mean": F.avg("qw_len").over(own), "qw_all": F.collect_list("qw_tf").over(own)})

    def share(t, i):
        times, tf = F.size(F.filter("qw_q", lambda x: x == t)).cast("double"), F.col("qw_tf")[i]
        df = times * F.size(F.filter("qw_all", lambda r: r[i] > 0))
        return F.when(tf > 0, bm25_term(times, tf, df, F.col("qw_n"), F.col("qw_len"), F.col("qw_mean"))).otherwise(0.0)

    over = F.aggregate(F.transform("qw_terms", share), F.lit(0.0), lambda s, x: s + x)
    return a.withColumn("keyword", F.when(F.col("qw_n") == 1, bm25_single(F.col("qw_q"), F.col("qw_d"))).otherwise(over)).drop(*(f"qw_{c}" for c in ("d", "terms", "len", "tf", "n", "mean", "all")))


def keyword_scores(cand: DataFrame) -> DataFrame:
    """query_id, memory_id, keyword."""
    return with_keywords(cand).select("query_id", "memory_id", "keyword")


def rank(cand: DataFrame, now, hybrid: bool = True, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """Adds score and rank (ties by candidate position).  Recency is that of the last access.  A blank query is scored without key
    words."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    s, r = semantic("q_emb", "embedding"), recency("last_accessed_at", now, half_life)
    classic = classic_score(s, r, F.col("importance"))
    if hybrid:
        scored = with_keywords(cand)
        scored = scored.withColumn("score", F.when(F.size("qw_q") > 0, hybrid_score(s, r, F.col("keyword"))).otherwise(classic)).drop("keyword", "qw_q")
    else:
        scored = cand.withColumn("score", classic)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def mmr_positions(items: Column, k: int, lam: float = LAMBDA) -> Column:
    """Ranks in order of choice, from array<struct<pos, score, v>> in rank order: greedily the highest
    lam * score - (1 - lam) * nearest chosen; ties take the earlier."""

    def pick(state):
        def value(r):
            near = F.array_max(F.transform(state["sel"], lambda s: F.when(r["v"].isNull() | s["v"].isNull(), 0.0).otherwise(cosine(r["v"], s["v"]))))
            return lam * r["score"] - (1 - lam) * F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0)))

        return F.array_max(F.transform(state["rem"], lambda r: F.struct(value(r).alias("m"), (-r["pos"]).alias("neg"))))["neg"]

    def step(state, _):
        return F.aggregate(
            F.array(pick(state)), state,
            lambda st, neg: F.struct(
                F.concat(st["sel"], F.filter(st["rem"], lambda r: r["pos"] == -neg)).alias("sel"),
                F.filter(st["rem"], lambda r: neg.isNull() | (r["pos"] != -neg)).alias("rem"),
            ),
        )

    start = F.struct(F.slice(items, 1, 0).alias("sel"), items.alias("rem"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda st: F.transform(st["sel"], lambda x: x["pos"]))


def mmr(ranked: DataFrame, k: int, lam: float = LAMBDA) -> DataFrame:
    """Re-ranks each query that has more than k rows to k diverse ones (k > 1); others stay."""
    if k <= 1:
        return ranked
    items = F.array_sort(F.collect_list(F.struct("rank", "score", F.struct(*ranked.columns).alias("row"))), lambda x, y: x["rank"] - y["rank"])
    light = F.transform("items", lambda x: F.struct(x["rank"].alias("pos"), x["score"].alias("score"), x["row"]["embedding"].alias("v")))
    order = F.when(F.size("items") > k, mmr_positions(light, k, lam)).otherwise(F.transform("items", lambda x: x["rank"]))
    chosen = ranked.groupBy("query_id").agg(items.alias("items")).select(F.posexplode(F.transform(order, lambda p: F.element_at("items", p)["row"])).alias("place", "row"))
    return chosen.select("row.*", (F.col("place") + 1).cast("int").alias("qw_place")).withColumn("rank", F.col("qw_place")).drop("qw_place")


def counted_by(counter) -> Column:
    """Tokens of ``content`` by a Python function from a text to a number, in Arrow batches."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(counter)

    return run(F.col("content"))


def token_budget(ranked: DataFrame, max_tokens: int | None, counter=None) -> DataFrame:
    """The ranks up to the first that overflows the budget; the first rank always stays.  ``counter``: a function from a text
    to its number of tokens, in place of words times 1.3."""
    if max_tokens is None:
        return ranked
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.withColumn("tokens", token_count("content") if counter is None else counted_by(counter))
    return sized.withColumn("spent", F.sum("tokens").over(upto)).drop("tokens").where((F.col("rank") == 1) | (F.col("spent") <= max_tokens)).drop("spent")


def recall_many(queries: DataFrame, memories: DataFrame, now, top_k: int = 5, max_tokens: int | None = None, states=None, hybrid: bool = True, half_life: float = HALF_LIFE_HOURS, counter=None, dimension: int | None = None) -> DataFrame:
    """Up to top_k rows for each query, with score and rank."""
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    ranked = rank(candidates(queries, memories, OVERFETCH * top_k, states, dimension), now, hybrid, half_life)
    return token_budget(mmr(ranked, top_k), max_tokens, counter).where(F.col("rank") <= top_k)


def recall_since(queries: DataFrame, memories: DataFrame, now, hours: float = 24, top_k: int = 5, **kwargs) -> DataFrame:
    """Recall of three times as many, then those created since, then top_k of them."""
    wide = recall_many(queries, memories, now, OVERFETCH * top_k, **kwargs)
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    cutoff = now - F.expr(f"make_dt_interval(0, 0, 0, {float(hours) * 3600})")
    order = Window.partitionBy("query_id").orderBy("rank")
    recent = wide.where(F.col("created_at") >= cutoff).withColumn("rank", F.row_number().over(order))
    return recent.where(F.col("rank") <= top_k)


def context_blocks(ranked: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """query_id, block: the prefix and a line for each row, in rank order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), x["content"]))
    return ranked.groupBy("query_id").agg(F.concat_ws("\n", F.lit(prefix), rows).alias("block"))
