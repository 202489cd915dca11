"""Embedding near-dedup by an epsilon grid order join.

Unit vectors lie on a sequence: sorted by their cells, of the width of the distance that the threshold allows, along the
leading principal directions (of the second moments of all vectors).  The sequence is cut into blocks with bounding boxes
in those directions.  The join starts with the whole sequence against itself and goes down level by level: two intervals
are split into ``FAN`` parts each, and pairs of parts whose boxes are farther apart than the threshold allows are dropped,
as projections never lengthen distances.  The pairs of blocks that remain are compared in double precision inside a
task, which gives sums of links and a spanning forest, never the pairs.

Equal vectors are one class with a count, so copies are compared once.  Vectors are scaled by a power of two before they are
multiplied, so lengths far from 1 neither overflow nor vanish; components that four bytes hold exactly travel so.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and is its
own component; vectors of different lengths link never; rows of one vec_id are rows of their own with equal results
if their vectors are equal; a null vec_id names no component unless all are null; an empty table gives an empty
result; other columns are ignored.  A class is known by 64 bits of its digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrywell.llm.common import dropped, table, written
from quarrywell.llm.components import components

COSINE, AXES, BLOCK, FAN = 0.9, 8, 2048, 8
_SLACK = 1e-9


def classes_of(rows: DataFrame) -> DataFrame:
    """vec_id, cid (null if the vector can't link), dim, v (its components, little-endian in 4 or 8 bytes each)."""

    def run(batches):
        for batch in batches:
            ids, dims, data = [], [], []
            for x in batch.column(1):
                v = None
                if x.is_valid and x.values.null_count == 0 and len(x.values):
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8") + 0.0
                    v = v if np.isfinite(v).all() and v.any() else None
                raw = None if v is None else v.tobytes()
                ids.append(None if v is None else int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True))
                dims.append(None if v is None else len(v))
                with np.errstate(over="ignore", under="ignore"):
                    short = None if v is None else v.astype("<f4")
                data.append(raw if v is None or not np.array_equal(short.astype("<f8"), v) else short.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "cid", "dim", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, cid long, dim int, v binary")


def _matrix(column: list[bytes], dim: int) -> np.ndarray:
    """The vectors as doubles."""
    if len({len(v) for v in column}) < 2:
        return np.frombuffer(b"".join(column), "<f4" if len(column[0]) == 4 * dim else "<f8").reshape(len(column), dim).astype(float)
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in column]).astype(float)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def directions(classes: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """For each length of vectors its leading principal directions, from the second moments of all of them.

    Each task sends one matrix for each length; these are added up in steps of ``FAN``, so the driver gets one."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = _units(_matrix(batch.column(1).filter(pa.array(dims == d)).to_pylist(), d))
                sums[d] = sums.get(d, 0) + x.T @ x
        yield from told(sums)

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[d] = sums.get(d, 0) + np.frombuffer(m.as_buffer(), "<f8").reshape(d, d)
        yield from told(sums)

    def told(sums):
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())], ["dim", "m"])

    found = classes.select("dim", "v").mapInArrow(moments, "dim int, m binary")
    parts = classes.rdd.getNumPartitions()
    found = written(found, "moments")
    while parts > 1:
        parts, last = -(-parts // FAN), found
        found = written(last.repartition(parts).mapInArrow(added, "dim int, m binary"), "moments")
        dropped(last)
    out = {r["dim"]: np.linalg.eigh(np.frombuffer(r["m"], "<f8").reshape(r["dim"], -1))[1][:, ::-1][:, :axes] for r in found.collect()}  # one row for each length
    dropped(found)
    return out


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """The grid order in blocks: part, nth, dim, lo, hi (arrays), and the block's classes, counts and vectors."""

    def project(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros((batch.num_rows, AXES), np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                p = _units(_matrix(batch.column("v").take(pa.array(own)).to_pylist(), d)) @ axes[d]
                cells[own, : p.shape[1]] = np.floor(p / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k].copy()) for k in range(AXES))], [*batch.schema.names, *(f"c{k}" for k in range(AXES))])

    def cut(batches):
        from pyspark import TaskContext

        part, nth, held, dim = TaskContext.get().partitionId(), 0, [], None

        def close():
            nonlocal nth, held
            cid, n, v = zip(*held)
            x = _matrix(v, dim)
            p = _units(x) @ axes[dim]
            v = v if len({len(b) for b in v}) == 1 else [b.tobytes() for b in x]
            lo, hi = np.zeros(AXES), np.zeros(AXES)
            lo[: p.shape[1]], hi[: p.shape[1]] = p.min(axis=0), p.max(axis=0)
            made = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([dim], pa.int32()), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([list(cid)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64())), pa.array([b"".join(v)], pa.binary())], ["part", "nth", "dim", "lo", "hi", "cids", "counts", "vs"])
            nth, held = nth + 1, []
            return made

        for batch in batches:
            for d, *row in zip(*(batch.column(n).to_pylist() for n in ("dim", "cid", "n", "v"))):
                if held and (d != dim or len(held) >= BLOCK):
                    yield close()
                dim = d
                held.append(row)
        if held:
            yield close()

    names = ["dim", *(f"c{k}" for k in range(AXES)), "cid"]
    placed = written(classes.select("cid", "n", "dim", "v").mapInArrow(project, "cid long, n long, dim int, v binary, " + ", ".join(f"c{k} int" for k in range(AXES))), "cells")
    parts = int(max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // BLOCK)))
    out = placed.repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInArrow(cut, "part int, nth int, dim int, lo array<double>, hi array<double>, cids array<long>, counts array<long>, vs binary")
    out = written(out, "blocks")
    dropped(placed)
    return out


def _block_pairs(boxes: DataFrame, n_blocks: int, epsilon: float) -> DataFrame:
    """a <= b: the pairs of blocks (by their place in the sequence) that may hold links."""
    levels = 0
    while FAN**levels < n_blocks:
        levels += 1
    spark = boxes.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    sides = [F.min(F.col("lo")[k]).alias(f"lo{k}") for k in range(AXES)] + [F.max(F.col("hi")[k]).alias(f"hi{k}") for k in range(AXES)]
    for level in range(levels - 1, -1, -1):
        at = boxes.groupBy(F.floor(F.col("seq") / FAN**level).alias("i")).agg(*sides, F.min("dim").alias("d0"), F.max("dim").alias("d1"))
        named = lambda x: at.select(F.col("i").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in at.columns if c != "i"))  # noqa: E731, B023
        parts = F.sequence(F.lit(0), F.lit(FAN - 1))
        split = pairs.select((F.col("a") * FAN).alias("a0"), (F.col("b") * FAN).alias("b0"), F.explode(parts).alias("i")).select("a0", "b0", "i", F.explode(parts).alias("j"))
        split = split.select((F.col("a0") + F.col("i")).alias("a"), (F.col("b0") + F.col("j")).alias("b")).where("a <= b")
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), F.lit(2.0)) for k in range(AXES)), F.lit(0.0))
        near = (gap <= epsilon * epsilon + _SLACK) & (F.col("a_d0") <= F.col("b_d1")) & (F.col("b_d0") <= F.col("a_d1"))
        last, pairs = pairs, written(split.join(named("a"), "a").join(named("b"), "b").where(near).select("a", "b"), "block-pairs")
        dropped(last)
    return pairs


def _compared(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """For each pair of blocks: cid, n (links, copies counted), root (a class it is connected with there)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                yield _links(row, cosine)

    left = blocks.select(F.col("seq").alias("a"), F.col("dim").alias("a_dim"), *(F.col(c).alias(f"a_{c}") for c in ("cids", "counts", "vs")))
    right = blocks.select(F.col("seq").alias("b"), F.col("dim").alias("b_dim"), *(F.col(c).alias(f"b_{c}") for c in ("cids", "counts", "vs")))
    both = pairs.join(left, "a").join(right, "b").where("a_dim = b_dim")  # null-free: each block has a length
    return both.mapInArrow(run, "cid long, n long, root long")


def _links(row: dict, cosine: float) -> pa.RecordBatch:
    each = lambda s: len(row[f"{s}_vs"]) // len(row[f"{s}_cids"])
    x, y = (_scaled(_matrix([row[f"{s}_vs"][k : k + each(s)] for k in range(0, len(row[f"{s}_vs"]), each(s))], row["a_dim"])) for s in "ab")
    nx, ny = (np.sqrt((m * m).sum(axis=1)) for m in (x, y))
    hit = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), 256):
        hit[k : k + 256] = (x[k : k + 256] @ y.T) / (nx[k : k + 256, None] * ny) >= cosine
    own = row["a"] == row["b"]
    if own:
        np.fill_diagonal(hit, False)
    nodes = np.array(row["a_cids"] if own else row["a_cids"] + row["b_cids"], np.int64)
    i, j = np.nonzero(hit)
    weight = np.zeros(len(nodes), np.int64)
    np.add.at(weight, i, np.array(row["b_counts"], np.int64)[j])
    j = j if own else j + len(x)
    if not own:
        np.add.at(weight, j, np.array(row["a_counts"], np.int64)[i])
    label = np.arange(len(nodes))
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    held = np.flatnonzero(weight)
    return pa.RecordBatch.from_arrays([pa.array(nodes[held]), pa.array(weight[held]), pa.array(nodes[label[held]])], ["cid", "n", "root"])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    epsilon = (2 - 2 * cosine) ** 0.5
    marked = written(classes_of(rows), "vectors")
    classes = written(marked.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("n"), F.min("vec_id").alias("member"), F.first("dim").alias("dim"), F.first("v").alias("v")), "vector-classes")
    cut = _blocks(classes, directions(classes), epsilon)
    # One short row for each block is numbered in sequence.
    order = cut.select("part", "nth", (F.row_number().over(Window.orderBy("part", "nth")) - 1).cast("long").alias("seq"))
    blocks = written(cut.join(order, ["part", "nth"]), "blocks")
    dropped(cut)
    pairs = _block_pairs(blocks.select("seq", "dim", "lo", "hi"), blocks.count(), epsilon)
    found = written(_compared(pairs, blocks, cosine), "vector-links")
    dropped(blocks, pairs)
    sums = found.groupBy("cid").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")).where("u <> v"))
    named = classes.select("cid", "n", "member").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    name = written(named.groupBy("component").agg(F.min("member").alias("component_id")), "names")
    by_class = written(named.join(name, "component").join(sums, "cid", "left").select("cid", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes-named")
    dropped(classes, found, labels, name)
    out = marked.select("vec_id", "cid").join(by_class, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
