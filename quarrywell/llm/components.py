"""Connected components by alternating large-star and small-star steps, each round after a contraction inside the
partitions that the edges happen to lie in.

Every step groups (with partial sums) and joins written tables, so a node with very many edges is split by adaptive
execution, and a lost executor costs one step.  Nothing is collected; the driver sees one row a round.  ``FEW`` edges or
less, at any round, are contracted by one task, as their arrays take a few MB whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywell.llm.common import dropped, written

FEW = 1 << 18
ROUNDS = 60  # far above what log-like convergence needs; more is an error, not a wrong result


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
    dropped(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Edges have u > v; the result is contracted."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(_contracted(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()), "edges")
    dropped(least)
    return out


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: every node there with the smallest one that it reaches there.  No shuffle."""

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = place[: len(u)], place[len(u) :]
        label = np.arange(len(nodes))  # places are in the order of the nodes
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)  # a root takes the smallest label next to its nodes
            np.minimum.at(label, label[j], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            if np.array_equal(label, before):
                break
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, v of undirected edges -> node, component (the smallest node reachable), for nodes with edges; a written table."""
    now = written(_contracted(edges.where("u <> v")), "edges")
    before = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        if mark[0] <= FEW:
            last, now = now, written(_contracted(now.coalesce(1)), "edges")
            dropped(last)
            break
        before, last, wide = mark, now, _large(now)
        now = _small(wide)
        dropped(last, wide)
    else:
        raise RuntimeError("components did not converge")
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    dropped(now)
    return out
