"""Counts over the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywell.operators.recall import in_states
from quarrywell.schema import SOURCES, STATES


def _n(c) -> F.Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def stats(memories: DataFrame, by_user: bool = True, states=None) -> DataFrame:
    """Totals, mean importance (0 if none), counts by state and by source (0 where none), with and without tags."""
    rows = memories.where(in_states(states))
    tagged = F.size(F.coalesce("tags", F.array())) > 0
    aggs = [F.count("*").alias("total"), F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"), _n(tagged).alias("with_tags"), _n(~tagged).alias("without_tags")]
    aggs += [_n(F.col("lifecycle_state") == s).alias(f"state_{s}") for s in STATES] + [_n(F.col("source") == s).alias(f"source_{s}") for s in SOURCES]
    return rows.groupBy("user_id").agg(*aggs) if by_user else rows.agg(*aggs)


def tag_counts(memories: DataFrame, states=None) -> DataFrame:
    return memories.where(in_states(states)).select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))


def user_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("user_id").agg(F.count("*").alias("n"))


def global_stats(memories: DataFrame) -> DataFrame:
    return memories.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("memories"))
