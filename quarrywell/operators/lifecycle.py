"""Lifecycle states: evaluation, allowed transitions, touching recalled rows, a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywell.functions.scoring import hours_between
from quarrywell.schema import ACTIVE, ARCHIVED, DECAYING, DELETED

ALLOWED = {(ACTIVE, DECAYING), (ACTIVE, DELETED), (DECAYING, ACTIVE), (DECAYING, DELETED)}


def evaluate(state: Column, accessed: Column, now: Column, threshold_hours: float = 720.0) -> Column:
    """Deleted and archived stay; others decay once not accessed for over the threshold."""
    h = hours_between(accessed, now)
    return F.when(state.isin(DELETED, ARCHIVED), state).when(h > threshold_hours, F.lit(DECAYING)).otherwise(F.lit(ACTIVE))


def may_change(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, b in sorted(ALLOWED):
        out = out | ((old == a) & (new == b))
    return out


def transition(df: DataFrame, new: str | Column) -> DataFrame:
    """All rows in the new state, tags and all; fails on a transition that is not allowed."""
    new = F.lit(new) if isinstance(new, str) else new
    old = F.col("lifecycle_state")
    wrong = F.raise_error(F.concat(F.lit("invalid transition: "), old, F.lit(" -> "), new))
    return df.withColumn("lifecycle_state", F.when(may_change(old, new), new).otherwise(wrong))


def touch(df: DataFrame, now, threshold_hours: float = 720.0, persist_access: bool = False) -> DataFrame:
    """The rows to store after a recall: those whose state changes, with access time ``now``; persist_access: all."""
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    new = evaluate(F.col("lifecycle_state"), now, now, threshold_hours)
    rows = df.withColumn("new_state", new).withColumn("last_accessed_at", now)
    rows = rows if persist_access else rows.where("new_state <> lifecycle_state")
    return rows.withColumn("lifecycle_state", F.col("new_state")).drop("new_state")


def sweep(df: DataFrame, now, threshold_hours: float = 720.0) -> DataFrame:
    """The rows whose state by access time differs from the stored one, in the new state."""
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    new = evaluate(F.col("lifecycle_state"), F.col("last_accessed_at"), now, threshold_hours)
    return df.withColumn("new_state", new).where("new_state <> lifecycle_state").withColumn("lifecycle_state", F.col("new_state")).drop("new_state")
