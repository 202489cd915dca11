"""Relevance scores, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywell.functions.vector import _c

K1, B, HALF_LIFE_HOURS = 1.5, 0.75, 168.0
HYBRID, CLASSIC = (0.6, 0.25, 0.15), (0.5, 0.3, 0.2)


def hours_between(then, now) -> Column:
    return (F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(_c(then).cast("timestamp"))) / 3.6e9


def recency(then, now, half_life: float = HALF_LIFE_HOURS) -> Column:
    """1 now and in the future, half after each half-life."""
    h = hours_between(then, now)
    return F.when(h <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -h / half_life))


def clamp(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x).cast("double")))


def bm25_single(query_tokens: Column, doc_tokens: Column) -> Column:
    """Keyword score against one document, from 0 to 1; a repeated query word counts again."""
    tf = lambda q: F.size(F.filter(doc_tokens, lambda t: t == q)).cast("double")
    total = F.aggregate(query_tokens, F.lit(0.0), lambda s, q: s + F.when(tf(q) > 0, tf(q) * (K1 + 1) / (tf(q) + K1)).otherwise(0.0))
    most = F.size(query_tokens) * ((K1 + 1) / K1)
    return F.when((F.size(query_tokens) > 0) & (F.size(doc_tokens) > 0), F.least(F.lit(1.0), total / F.nullif(most, F.lit(0.0)))).otherwise(0.0)


def bm25_term(times: Column, tf: Column, df: Column, n_docs: Column, length: Column, mean_length: Column) -> Column:
    """One query word's share: ``times`` in the query, ``tf`` in the document, ``df`` = times * documents with it."""
    mean = F.when(mean_length > 0, mean_length).otherwise(1.0)
    return times * F.ln((n_docs + 1) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def hybrid_score(semantic: Column, recent: Column, keyword: Column) -> Column:
    return HYBRID[0] * semantic + HYBRID[1] * recent + HYBRID[2] * keyword


def classic_score(semantic: Column, recent: Column, importance: Column) -> Column:
    return CLASSIC[0] * semantic + CLASSIC[1] * recent + CLASSIC[2] * clamp(importance)
