"""Chat turns as rows to remember: what people said, not what was answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywell.schema import ACTIVE, RECORD, USER_STATED


def spoken(turns: DataFrame, embed, now: Column, role: str = "user") -> DataFrame:
    """Records of all turns (conv_id, turn, role, text) of ``role`` that say something, in order, for ``dedup.folded``: a
    conversation is a user."""
    said = turns.where((F.col("role") == role) & (F.trim("text") != ""))
    rows = said.select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("memory_id"), F.concat(F.lit("u"), "conv_id").alias("user_id"), F.col("text").alias("content"), embed.column(F.col("text")).alias("embedding"),
        F.lit(embed.dimension()).alias("embedding_dim"), now.alias("created_at"), now.alias("last_accessed_at"), F.lit(USER_STATED).alias("source"), F.lit(0.5).alias("importance"), F.lit(ACTIVE).alias("lifecycle_state"),
        F.lit("{}").alias("metadata"), F.array().cast("array<string>").alias("tags"), F.col("turn").cast("long").alias("seq"),
    )
    return rows.select([f.name for f in RECORD.fields])
