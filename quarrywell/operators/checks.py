"""What is wrong with a row that is to be remembered, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywell.functions.text import tokens
from quarrywell.schema import SOURCES


def problem(columns) -> Column:
    """The first fault of a row of user_id, content and, among ``columns``, importance and source; null if there is none."""
    blank = lambda c: F.size(tokens(F.coalesce(F.col(c), F.lit("")))) == 0
    out = F.when(blank("user_id"), "user_id must not be blank").when(blank("content"), "content must not be blank")
    if "importance" in columns:
        out = out.when(F.col("importance").isNotNull() & F.col("importance").try_cast("double").isNull(), "importance must be a number")
    if "source" in columns:
        out = out.when(F.col("source").isNotNull() & ~F.col("source").isin(list(SOURCES)), "unknown source")
    return out.otherwise(F.lit(None).cast("string"))


def fail_where(value: str, fault: str) -> Column:
    """``value``, or a failure of the job where the row has a fault."""
    return F.when(F.col(fault).isNotNull(), F.raise_error(F.col(fault)).cast("string")).otherwise(F.col(value))
