"""Vector arithmetic in double precision, Column to Column, and the deterministic hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a vector is null, empty, zero or gives no number; norms can be handed in."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    out = F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
    return F.when(F.isnan(out) | out.isNull(), 0.0).otherwise(out)


def ncos(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return (cosine(a, b, norm_a, norm_b) + 1.0) / 2.0


def semantic(a, b) -> Column:
    """ncos, but 0 where either vector is null; an empty one counts as at right angles (0.5)."""
    return F.when(_c(a).isNull() | _c(b).isNull(), 0.0).otherwise(ncos(a, b))


def hash_embed(text, dim: int = 64) -> Column:
    """Bytes of the text's SHA-256 over 255, repeated to ``dim`` components."""
    sha = F.sha2(_c(text), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(sha, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0).cast("float"))
