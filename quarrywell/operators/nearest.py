"""Exact nearest rows of each query's user without scoring all of them.

The rows lie in blocks with ranges of distances to pivots (see ``nearness``).  By the triangle inequality a query's distances to
the pivots bound its similarity to anything in a block from above.  Each query is scored against its ``FIRST`` blocks by that bound;
its k-th best there is a threshold, and only blocks whose bound reaches it are scored besides.  So nothing that could be among the
k best is passed over, and no loop runs on the driver.  The blocks are written once and serve any number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrywell.operators.nearness import PIVOTS, _doubles, _units, blocks, packed, pivots, written

FIRST = 2
_SLACK = 1e-6
_FOUND = "query_id string, memory_id string, seq long, sim double"


class Nearest:
    """An index over rows (user_id, memory_id, seq, embedding).  Rows without a vector are not in it."""

    def __init__(self, rows: DataFrame, scratch: list[str] | None = None):
        scratch = [] if scratch is None else scratch
        kept = written(packed(rows), "nearest-rows", scratch)
        self.at = pivots(kept)
        self.blocks = blocks(kept, self.at, scratch)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, user_id, dim, v, far (distances to the pivots)."""
        at = self.at

        def run(batches):
            for b in batches:
                far = []
                for d, v in zip(b.column("dim").to_pylist(), b.column("v").to_pylist()):
                    out = np.zeros(PIVOTS)
                    if d in at and d:
                        gap = at[d] - _units([v], d)
                        out[: len(gap)] = np.sqrt((gap * gap).sum(axis=1))
                    far.append(out.tolist())
                yield pa.RecordBatch.from_arrays([b.column("memory_id"), b.column("user_id"), b.column("dim"), b.column("v"), pa.array(far, pa.list_(pa.float64()))], ["query_id", "user_id", "dim", "v", "far"])

        named = queries.select("user_id", F.col("query_id").cast("string").alias("memory_id"), F.lit(0).cast("long").alias("seq"), "embedding")
        return packed(named).mapInArrow(run, "query_id string, user_id string, dim int, v binary, far array<double>")

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, no, n, bound: the most that a row of the block can reach."""
        heads = self.blocks.select("user_id", "dim", "no", "n", "lo", "hi")
        both = self._asked(queries).join(heads, ["user_id", "dim"])
        gap = F.greatest(F.lit(0.0), *(F.col("lo")[k] - F.col("far")[k] for k in range(PIVOTS)), *(F.col("far")[k] - F.col("hi")[k] for k in range(PIVOTS))) - F.lit(_SLACK)
        gap = F.greatest(F.lit(0.0), gap)
        # Vectors without direction lie at the origin, at a similarity of a half, which the formula for unit vectors never puts lower.
        return both.select("query_id", "v", "no", "n", (1 - gap * gap / 4).alias("bound"))

    def _scored(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best of each query in each block."""

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                    x, q = _sides(row["vs"], len(row["ids"]), row["dim"]), _sides(row["v"], 1, row["dim"])
                    sim = ((x * q).sum(axis=1) + 1.0) / 2.0
                    seq = np.array([s if s is not None else np.iinfo(np.int64).max for s in row["seqs"]], np.int64)
                    top = np.lexsort((seq, -sim))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([row["query_id"]] * len(top)), pa.array([row["ids"][t] for t in top], pa.string()), pa.array([row["seqs"][t] for t in top], pa.int64()), pa.array(sim[top])], ["query_id", "memory_id", "seq", "sim"])

        return pairs.join(self.blocks.select("no", "dim", "ids", "seqs", "vs"), "no").mapInArrow(run, _FOUND)

    def topk(self, queries: DataFrame, k: int, scratch: list[str] | None = None) -> DataFrame:
        """query_id, memory_id, seq, sim, pos: the k nearest rows of each query's user; ties by seq.  ``queries``: query_id, user_id, embedding."""
        scratch = [] if scratch is None else scratch
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "no")
        bounds = written(self.bounds(queries).withColumn("nth", F.row_number().over(order)), "nearest-bounds", scratch)
        first = written(self._scored(bounds.where(F.col("nth") <= FIRST).select("query_id", "v", "no"), k), "nearest-first", scratch)
        best = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.col("seq").asc_nulls_last(), "memory_id")
        least = first.withColumn("pos", F.row_number().over(best)).where(F.col("pos") == k).select("query_id", F.col("sim").alias("least"))
        rest = bounds.where(F.col("nth") > FIRST).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        self.asked = bounds, rest
        every = first.unionAll(self._scored(rest.select("query_id", "v", "no"), k))
        return every.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)

    def share(self) -> float:
        """Of the rows of the users asked, the share that the last ``topk`` scored."""
        bounds, rest = self.asked
        total = lambda df: df.agg(F.sum("n")).first()[0] or 0
        return (total(bounds.where(F.col("nth") <= FIRST)) + total(rest)) / max(1, total(bounds))


def _sides(data: bytes, n: int, dim: int) -> np.ndarray:
    each = len(data) // n
    return _units([data[k : k + each] for k in range(0, len(data), each)], dim) if dim else _doubles(b"", n, 0)
