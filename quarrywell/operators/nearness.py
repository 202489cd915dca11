"""Exact threshold joins of vectors within a user, below all pairs: pivots, the triangle inequality, and blocks.

Vectors are compared as unit vectors, where a similarity above ``low`` means a distance below some ``reach``.  Each row knows
its distances to ``PIVOTS`` vectors; two rows whose distances to one pivot differ by more than the reach can't be near.  Rows are
sorted by user, nearest pivot and distance to it, and cut into blocks that carry the range of their distances to every
pivot.  Blocks that follow each other travel in bundles.  Bundles are joined by their ranges first, as short rows; only pairs of
bundles that may hold near rows are given their vectors, and of their blocks only those that may are compared, by one matrix
product each.  So a row's vector is sent once for each bundle of its user that it may meet, and not for each block; where rows are held against
those before them, a pair of bundles is sent once for both ways.  The pivots come from ``SAMPLE`` rows at most; they decide what is compared,
never what is near.

A user with very many blocks is dealt to a grid of groups, so that no task sees all its pairs of blocks.  Tables are written
to the session's shared folder; their paths are told to ``scratch``, for whoever uses up the result to delete.

Defined results: a null vector is near nothing; one that is zero or has a component that is no number is at right angles to all
(a similarity of a half); vectors of different lengths are no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywell.sources.folders import shared_path

PIVOTS, SAMPLE, BLOCK, GRID = 32, 4096, 512, 1 << 14
#: Rows of a bundle, and bytes of their vectors and marks: what a task holds twice, and more than once over as doubles.
BUNDLE, BUNDLE_BYTES = 1 << 14, 8 << 20
#: Few rows are dealt to some tasks all the same, but to none with fewer than these.
LEAST = 1 << 11
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
MARKED = 1 << 16  # pairs whose marks are compared at once
_ROUNDING = 1e-6  # more than distances of nearly equal vectors can be off
_EDGE = 1e-9  # a similarity so close to a threshold is summed up again in the order of the components


def written(df: DataFrame, kind: str, scratch: list[str]) -> DataFrame:
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _doubles(data: bytes, n: int, dim: int) -> np.ndarray:
    """Vectors kept as floats or as doubles."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype("<f8", copy=False) if dim else np.zeros((n, 0))


def _units(v: list[bytes], dim: int) -> np.ndarray:
    x = _doubles(b"".join(v), len(v), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
    fine = (size > 0) & np.isfinite(size)
    return np.where(fine[:, None], x, 0.0) / np.where(fine, size, 1.0)[:, None]


def packed(rows: DataFrame) -> DataFrame:
    """user_id, memory_id, seq, mark (bytes for a ``verdict``, where rows have them), dim, v (floats where the rows have floats, else
    doubles; zeros for a vector without direction)."""
    kind, held = ("<f4", "array<float>") if rows.schema["embedding"].dataType.simpleString() == "array<float>" else ("<f8", "array<double>")

    def run(batches):
        for b in batches:
            dims, out, keep = [], [], []
            for k, x in enumerate(b.column(4)):
                if not x.is_valid:
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), kind)
                keep.append(k)
                dims.append(len(v))
                out.append((v if np.isfinite(v).all() else np.zeros(len(v), kind)).tobytes())
            some = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(some) for k in range(4)), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["user_id", "memory_id", "seq", "mark", "dim", "v"])

    mark = (F.col("mark") if "mark" in rows.columns else F.lit(None)).cast("binary").alias("mark")
    return rows.select("user_id", "memory_id", F.col("seq").cast("long").alias("seq"), mark, F.col("embedding").cast(held).alias("e")).mapInArrow(run, "user_id string, memory_id string, seq long, mark binary, dim int, v binary")


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors some far from each other, chosen one by one."""
    out, by_dim = {}, {}
    for r in rows.select("dim", "v").limit(SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(bytes(r["v"]))
    for dim, v in by_dim.items():
        x = _units(v, dim)
        chosen, far = [x[0]], np.full(len(x), np.inf)
        while len(chosen) < PIVOTS:
            far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
            if far.max() <= 1e-12:
                break
            chosen.append(x[int(far.argmax())])
        out[dim] = np.stack(chosen)
    return out


def blocks(rows: DataFrame, at: dict[int, np.ndarray], scratch: list[str], bundled: bool = False) -> DataFrame:
    """no, user_id, dim, n, lo and hi (ranges of distances to the pivots), first seq, last seq (null if a row has none), and the rows; a written
    table.  ``bundled``: bundles of blocks, with ``ranges``, the lo and hi of each of them; ``rows`` is a written table then."""
    most, most_bytes = (BUNDLE, BUNDLE_BYTES) if bundled else (BLOCK, np.inf)
    step = BLOCK

    def placed(batches):
        for b in batches:
            dims, near, apart, all_ = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros((b.num_rows, PIVOTS))
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d in at and d:
                    x = _units(b.column("v").take(pa.array(own)).to_pylist(), d)
                    dist = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (at[d] * at[d]).sum(axis=1)[None, :] - 2 * (x @ at[d].T)))
                    all_[own, : dist.shape[1]] = dist
                    near[own], apart[own] = dist.argmin(axis=1), dist.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(apart), pa.array([r.tobytes() for r in all_], pa.binary())], [*b.schema.names, "near", "apart", "far"])

    def cut(batches):
        from pyspark import TaskContext

        no, held, key, size = TaskContext.get().partitionId() << 32, [], None, 0

        def close():
            nonlocal no, held, size
            ids, seqs, marks, v, far = zip(*held)
            far = np.frombuffer(b"".join(far)).reshape(-1, PIVOTS)
            each = range(0, len(ids), step)
            ranges = np.stack([np.minimum.reduceat(far, each), np.maximum.reduceat(far, each)], axis=1)
            data = {
                "no": [no], "user_id": pa.array([key[0]], pa.string()), "dim": pa.array([key[1]], pa.int32()), "n": [len(ids)], "lo": [far.min(axis=0).tolist()], "hi": [far.max(axis=0).tolist()],
                "first": pa.array([min((s for s in seqs if s is not None), default=None)], pa.int64()), "last": pa.array([None if None in seqs else max(seqs)], pa.int64()),
                "ids": pa.array([list(ids)], pa.list_(pa.string())), "seqs": pa.array([list(seqs)], pa.list_(pa.int64())), "marks": pa.array([b"".join(m or b"" for m in marks)], pa.binary()), "vs": [b"".join(v)], "ranges": [ranges.tobytes()],
            }
            no, held, size = no + 1, [], 0
            return pa.RecordBatch.from_pydict(data)

        for b in batches:
            for user, dim, *row in zip(*(b.column(n).to_pylist() for n in ("user_id", "dim", "memory_id", "seq", "mark", "v", "far"))):
                more = len(row[2] or b"") + len(row[3])
                if held and ((user, dim) != key or len(held) >= most or size + more > most_bytes):
                    yield close()
                key = user, dim
                held.append(row)
                size += more
        if held:
            yield close()

    kind = "user_id string, memory_id string, seq long, mark binary, dim int, v binary, near int, apart double, far binary"
    order = ["user_id", "dim", "near", "apart", "memory_id"]  # the last tells rows alike apart, however many
    parts = ()
    if bundled:
        # A range of rows should fill its bundles.
        n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
        parts = (max(1, -(-n // BUNDLE), -(-8 * numbers // BUNDLE_BYTES), min(2 * rows.sparkSession.sparkContext.defaultParallelism, n // LEAST)),)
    ranged = rows.mapInArrow(placed, kind).repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    held = "no long, user_id string, dim int, n long, lo array<double>, hi array<double>, first long, last long, ids array<string>, seqs array<long>, marks binary, vs binary, ranges binary"
    return written(ranged.mapInArrow(cut, held), "near-blocks", scratch)


def _reach(low: float) -> float:
    return (2 - 2 * (2 * low - 1)) ** 0.5 + _ROUNDING if low > 0 else np.inf


def block_pairs(new: DataFrame, old: DataFrame, low: float, before: bool) -> DataFrame:
    """a, b: the bundles that may hold rows with a similarity above ``low``.  ``before``, of a table with itself: each two of them once."""
    key = ["user_id", "dim"]
    heads = lambda df, x: df.select(*key, *(F.col(c).alias(f"{x}_{c}") for c in ("no", "lo", "hi", "first", "last")))
    a, b = heads(new, "a"), heads(old, "b")
    size = a.groupBy(*key).agg(F.count("*").alias("na")).join(b.groupBy(*key).agg(F.count("*").alias("nb")), key)
    large = size.select(*key, F.ceil(F.sqrt(F.col("na") * F.col("nb") / F.lit(GRID))).cast("int").alias("g")).where("g > 1")
    spread = lambda df, x, own, other: df.join(large, key, "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn(own, F.pmod(F.hash(f"{x}_no"), F.col("g"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("g") - 1))).drop("g")
    both = spread(a, "a", "ga", "gb").join(spread(b, "b", "gb", "ga"), [*key, "ga", "gb"])
    apart = F.greatest(*(F.col(f"{x}_lo")[k] - F.col(f"{y}_hi")[k] for k in range(PIVOTS) for x, y in ("ab", "ba")))
    near = both.where(apart <= _reach(low))
    if before and old is new:
        near = near.where(F.col("a_no") <= F.col("b_no"))
    elif before:
        near = near.where(F.col("a_last").isNull() | F.coalesce(F.col("b_first") <= F.col("a_last"), F.lit(False)))
    return near.select(F.col("a_no").alias("a"), F.col("b_no").alias("b"))


def _side(vs: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = _doubles(vs, n, dim)
    with np.errstate(over="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
    fine = (size > 0) & np.isfinite(size)
    return np.where(fine[:, None], x, 0.0), np.where(fine, size, 1.0)


def _in_order(x: np.ndarray, y: np.ndarray) -> float:
    """The similarity, summed up component by component."""
    dot = a = b = 0.0
    for p, q in zip(x.tolist(), y.tolist()):
        dot, a, b = dot + p * q, a + p * p, b + q * q
    size = a**0.5 * b**0.5
    return (dot / size + 1.0) / 2.0 if size > 0 else 0.5


class _Bundle:
    """One side of a pair of bundles."""

    def __init__(self, cell, x: str, dim: int):
        self.ids, self.seqs = cell(f"{x}_ids").values, cell(f"{x}_seqs").values
        self.v, self.size = _side(cell(f"{x}_vs").as_py(), len(self.ids), dim)
        ranges = np.frombuffer(cell(f"{x}_ranges").as_py()).reshape(-1, 2, PIVOTS)
        self.lo, self.hi = ranges[:, 0], ranges[:, 1]
        self.marks = np.frombuffer(cell(f"{x}_marks").as_py(), np.uint8).reshape(len(self.ids), -1)
        self.order = self.told = None  # of each row its place in the store, and what the task has told of it

    def places(self) -> list[tuple]:
        # Null places come last; ties go by id.
        return [(s is None, s or 0, i) for s, i in zip(self.seqs.to_pylist(), self.ids.to_pylist())]


def _met_blocks(batches, low: float, same: bool, step: int):
    """user, the bundles a and b, slices of their rows, and whether they stand for both ways: blocks that may hold near rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda name: batch.column(name)[k]  # noqa: B023, E731
            a, b = (_Bundle(cell, x, cell("a_dim").as_py()) for x in "ab")
            user, one = cell("a_user_id").as_py(), same and cell("a").as_py() == cell("b").as_py()
            apart = np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]).max(axis=2)
            for p, q in np.argwhere(apart <= _reach(low)).tolist():
                if not (one and p > q):
                    yield user, a, b, slice(p * step, (p + 1) * step), slice(q * step, (q + 1) * step), same and not (one and p == q)


def _hits(batches, low: float, high: float | None, before: bool, same: bool, step: int, placed: bool = False):
    """user, new bundle, old bundle, new and old places in them, and similarities strictly between the thresholds; ``placed``: the
    bundles' rows have their ``order`` in the store."""
    for user, a, b, p, q, both in _met_blocks(batches, low, same, step):
        if a.order is None and (before or placed):
            mine, theirs = a.places(), b.places()
            every = {x: k for k, x in enumerate(sorted({*mine, *theirs}))}
            a.order, b.order = (np.array([every[x] for x in own]) for own in (mine, theirs))
        x, y = a.v[p], b.v[q]
        sim = ((x @ y.T) / (a.size[p, None] * b.size[None, q]) + 1.0) / 2.0
        for edge in (low, high):
            if edge is not None:
                for i, j in zip(*np.nonzero(np.abs(sim - edge) < _EDGE)):
                    sim[i, j] = _in_order(x[i], y[j])
        i, j = np.nonzero(sim > low if high is None else (sim > low) & (sim < high))
        sim, i, j = sim[i, j], i + p.start, j + q.start
        later = a.order[i] - b.order[j] if before else np.ones(len(i))
        if (hit := later > 0).any():
            yield user, a, b, i[hit], j[hit], sim[hit]
        if both and (hit := later < 0).any():
            yield user, b, a, j[hit], i[hit], sim[hit]


def _sides(new: DataFrame, old: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    # A pair of bundles is some MB; Spark's own limit of 64 MB would bring a task many at once.
    if _BATCH not in new.sparkSession.conf.getAll:
        new.sparkSession.conf.set(_BATCH, str(4 << 20))
    rows = written(packed(new), "near-rows", scratch)
    at = pivots(rows)
    left = blocks(rows, at, scratch, True)
    return left, left if old is new else blocks(written(packed(old), "near-rows", scratch), at, scratch, True)


def _met(left: DataFrame, right: DataFrame, low: float, before: bool) -> DataFrame:
    pick = lambda df, x, more: df.select(F.col("no").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in (*more, "ids", "seqs", "marks", "vs", "ranges")))
    return block_pairs(left, right, low, before).join(pick(left, "a", ["user_id", "dim"]), "a").join(pick(right, "b", []), "b")


def _row(user, a: _Bundle, b: _Bundle, i, j, sim) -> list[pa.Array]:
    i, j = pa.array(i), pa.array(j)
    return [pa.array([user] * len(i), pa.string()), a.ids.take(i), b.ids.take(j), pa.array(sim, pa.float64()), a.seqs.take(i), b.seqs.take(j)]


def near_pairs(new: DataFrame, old: DataFrame, low: float, high: float | None = None, before: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """user_id, new_id, old_id, sim, new_seq, old_seq of the pairs of one user's rows whose similarity is above low (and below high);
    ``before``: only pairs whose old row comes first (by seq, then id)."""

    def run(batches):
        for user, a, b, i, j, sim in _hits(batches, low, high, before, same, step):
            yield pa.RecordBatch.from_arrays(_row(user, a, b, i, j, sim), ["user_id", "new_id", "old_id", "sim", "new_seq", "old_seq"])

    scratch = [] if scratch is None else scratch
    left, right = _sides(new, old, scratch)
    same, step = before and right is left, BLOCK
    return _met(left, right, low, before).mapInArrow(run, "user_id string, new_id string, old_id string, sim double, new_seq long, old_seq long")


def near_said(new: DataFrame, old: DataFrame, low: float, verdict, before: bool = False, first: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """What ``near_pairs`` gives, and ``sure``.  ``verdict`` tells from the marks of both rows (bytes of one length) which pairs are
    dropped (0), sure (1) or still to be asked (2).  ``first``: of a new row's pairs only the first sure one in store order and the
    unsure ones before it; they are picked in each task, so rows with very many partners are not written out in pairs."""

    def run(batches):
        for user, a, b, i, j, sim in _hits(batches, low, None, before, same, step, first):
            said = np.concatenate([verdict(a.marks[i[at : at + MARKED]], b.marks[j[at : at + MARKED]]) for at in range(0, len(i), MARKED)])
            keep = said > 0
            if first:
                if a.told is None:  # the place of each row's first sure partner
                    a.told = np.full(len(a.ids), len(a.ids) + len(b.ids))
                np.minimum.at(a.told, i[said == 1], b.order[j[said == 1]])
                keep &= b.order[j] <= a.told[i]
            if keep.any():
                yield pa.RecordBatch.from_arrays([*_row(user, a, b, i[keep], j[keep], sim[keep]), pa.array(said[keep] == 1)], ["user_id", "new_id", "old_id", "sim", "new_seq", "old_seq", "sure"])

    scratch = [] if scratch is None else scratch
    left, right = _sides(new, old, scratch)
    same, step = before and right is left, BLOCK
    return _met(left, right, low, before).mapInArrow(run, "user_id string, new_id string, old_id string, sim double, new_seq long, old_seq long, sure boolean")


def near_ids(new: DataFrame, old: DataFrame, low: float, high: float | None = None, before: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """new_id of the rows that have such a partner, each once.  A task tells a row once for all its partners there, so no
    group of rows alike is written out in pairs."""

    def run(batches):
        for _, a, _, i, _, _ in _hits(batches, low, high, before, same, step):
            if a.told is None:
                a.told = np.zeros(len(a.ids), bool)
            i = np.unique(i[~a.told[i]])
            a.told[i] = True
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i))], ["new_id"])

    scratch = [] if scratch is None else scratch
    left, right = _sides(new, old, scratch)
    same, step = before and right is left, BLOCK
    return _met(left, right, low, before).mapInArrow(run, "new_id string").distinct()


def compared(new: DataFrame, old: DataFrame, low: float, before: bool = False) -> tuple[int, int]:
    """Pairs of rows that are compared, and all pairs of rows of one user: what the pivots save."""

    def run(batches):
        for _, a, b, p, q, _ in _met_blocks(batches, low, same, step):
            yield pa.RecordBatch.from_arrays([pa.array([len(a.v[p]) * len(b.v[q])])], ["pairs"])

    left, right = _sides(new, old, [])
    same, step = before and right is left, BLOCK
    n = _met(left, right, low, before).mapInArrow(run, "pairs long").agg(F.sum("pairs")).first()[0] or 0
    sizes = lambda df, x: df.groupBy("user_id").agg(F.sum("n").alias(x))
    return n, sizes(left, "x").join(sizes(right, "y"), "user_id").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def linked(edges: DataFrame, scratch: list[str]) -> DataFrame:
    """u, v (strings) -> node, root: the smallest id that a node reaches, by alternating large and small stars; a written table.
    Each step groups with partial sums and joins written tables."""
    now, before = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "near-stars", scratch), None
    for _ in range(60):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "near-stars", scratch)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "near-stars", scratch)
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
