"""Hard-negative mining by an orthogonal rotation onto principal directions.

Components are scaled and floored, so scores are inner products of integers.  All vectors are turned by one orthogonal
matrix, the principal directions of all rows, which changes no product and gathers most of a vector in its first
components.  For a block of anchors and a block of rows, the products over the first ``STEPS`` of the components are
summed up; what is missing is at most the product of the norms of what is left, plus ``slack`` for rounding.  A pair whose
bounds show that it can't come in is dropped after the first step or the second, and what survives all of them gets its
score from the integers themselves, so no result hangs on rounding.

Anchors are searched twice: for the best rows of their own label, where the best found so far rule others out, and then for
rows of other labels, where each positive's window of scores, and the best found in it, do.  Anchors alike in label
and vector are searched once.  Of rows alike in both only the ``positives + 1`` smallest ids can come among an anchor's best (one
may be the anchor itself), so others are left out of the search, not out of the anchors.

Blocks of anchors and of rows are dealt to a grid of groups, so that either side is shipped about as often as the square root of
the number of tasks; a task reads pairs of blocks one by one and keeps the best of one block of anchors.  The best of all
tasks are taken after a shuffle.  Blocks follow the label, but hold any, so one label may hold any share of the rows.

Defined results: a row with a null label or vector, or with a null or non-finite component, takes no part; nor does one whose squared
integers add up to ``LARGE`` or more, as products might not fit a long.  Vectors of different lengths never meet; empty
ones score 0.  Rows that are alike in id, label and vector are one row; other rows of one id are rows of their own.  A null id
comes after all others and is no anchor.  An anchor without positives has no rows, a positive without negatives none.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrywell.llm.common import dropped, table, written
from quarrywell.llm.op10_epsilon_grid import directions

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Shares of the components after which bounds are looked at, rows and anchors in a block, elements in a step of the check.
STEPS, ROWS, ANCHORS, PART, LARGE = (0.25, 0.5, 1.0), 2048, 256, 1 << 20, 1 << 54
GRID = 4  # cells of the grid for each partition of a shuffle
_LAST = (1 << 63) - 1  # stands for a null id


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim, v (the floored components, little-endian in 2, 4 or 8 bytes each) of the rows that take part, none twice."""

    def run(batches):
        for b in batches:
            ids, labels, dims, out = [], [], [], []
            for i, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if label is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), float)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                    if not (v * v).sum() < LARGE:
                        continue
                most = np.abs(v).max(initial=0)
                ids.append(i)
                labels.append(label)
                dims.append(len(v))
                out.append(v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "v"])

    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return named.mapInArrow(run, "vec_id long, label long, dim int, v binary").distinct()


def _ints(column: list[bytes], dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(column), 0), np.int64)
    if len({len(v) for v in column}) == 1:
        return np.frombuffer(b"".join(column), f"<i{len(column[0]) // dim}").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(v, f"<i{len(v) // dim}") for v in column]).astype(np.int64)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors an orthogonal matrix, its columns from the leading direction to the last."""

    def floats(batches):
        for b in batches:
            v = [(d, _ints([x], d)[0].astype("<f8")) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            v = [(d, x.tobytes()) for d, x in v if x.any()]  # others have no direction
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in v], pa.int32()), pa.array([x for _, x in v], pa.binary())], ["dim", "v"])

    return directions(rows.select("dim", "v").mapInArrow(floats, "dim int, v binary"), None)


def _blocks(rows: DataFrame, size: int, what: str) -> DataFrame:
    """Rows in the order of their lengths and labels, ``size`` a block: no, dim, low and high label, ids, labels, vs; a written table."""

    def cut(batches):
        from pyspark import TaskContext

        no, held, dim = TaskContext.get().partitionId() << 32, [], None

        def close():
            nonlocal no, held
            key, ids, labels, v = zip(*held)
            x = _ints(v, dim)
            wide = max([2, *(len(b) // dim for b in v)]) if dim else 2
            made = pa.RecordBatch.from_arrays(
                [pa.array([no]), pa.array([dim], pa.int32()), pa.array([min(labels)]), pa.array([max(labels)]), pa.array([list(key)], pa.list_(pa.int64())), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(labels)], pa.list_(pa.int64())), pa.array([x.astype(f"<i{wide}").tobytes()], pa.binary())],
                ["no", "dim", "low", "high", "keys", "ids", "labels", "vs"],
            )
            no, held = no + 1, []
            return made

        for b in batches:
            for d, *row in zip(*(b.column(n).to_pylist() for n in ("dim", "key", "vec_id", "label", "v"))):
                if held and (d != dim or len(held) >= size):
                    yield close()
                dim = d
                held.append(row)
        if held:
            yield close()

    placed = written(rows.select("dim", "key", F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), "label", "v"), f"{what}-rows")
    parts = int(max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // size)))
    order = ["dim", "label", "vec_id", "v"]
    out = written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, "no long, dim int, low long, high long, keys array<long>, ids array<long>, labels array<long>, vs binary"), what)
    dropped(placed)
    return out


def _paired(anchors: DataFrame, rows: DataFrame, keep: list[str], same: bool) -> DataFrame:
    """Each block of anchors with each block of rows that may hold rows of its labels (``same``), or of others."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, r, cells = max(1, anchors.count()), max(1, rows.count()), GRID * parts
    wide = min(r, max(1, round((cells * r / a) ** 0.5)))  # groups of rows, so of copies of each anchor
    tall = min(a, max(1, -(-cells // wide)))
    names = lambda df, x, cols: [F.col(c).alias(f"{x}_{c}") for c in cols]
    left = anchors.select("dim", F.pmod(F.xxhash64("no"), F.lit(tall)).alias("ga"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("gr"), *names(anchors, "a", ["no", "low", "high", "keys", "labels", "vs", *keep]))
    right = rows.select("dim", F.pmod(F.xxhash64("no"), F.lit(wide)).cast("int").alias("gr"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))).alias("ga"), *names(rows, "r", ["low", "high", "keys", "ids", "labels", "vs"]))
    over = (F.col("a_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("a_high"))
    alike = (F.col("a_low") == F.col("a_high")) & (F.col("a_low") == F.col("r_low")) & (F.col("r_low") == F.col("r_high"))
    left, right = (df.repartition(parts, "dim", "ga", "gr") for df in (left, right))  # by number: small to ship, long to work on
    return left.join(right.hint("merge"), ["dim", "ga", "gr"]).where(over if same else ~alike).drop("ga", "gr")


class _Side:
    """A block: integers, their rotation, and the norms of what each step leaves."""

    def __init__(self, data: bytes, n: int, dim: int, turn: np.ndarray | None):
        each = len(data) // n
        self.ints = _ints([data[k : k + each] for k in range(0, len(data), each)], dim) if each else np.zeros((n, 0), np.int64)
        self.turned = self.ints.astype(float) @ turn if turn is not None else self.ints.astype(float)
        self.norm = np.sqrt((self.turned * self.turned).sum(axis=1))
        self.steps = sorted({max(1, round(dim * s)) for s in STEPS}) if dim else [0]
        self.left = [np.sqrt((self.turned[:, m:] * self.turned[:, m:]).sum(axis=1)) if m < dim else np.zeros(n) for m in self.steps]


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity."""
    return np.partition(x, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _scores(a: _Side, r: _Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """Pairs i, j and their scores.  ``low``, ``high``: an anchor's windows (anchors x windows); a pair is wanted if it may lie in a
    window and be among the k best there.  Raises ``low`` to what k pairs are known to reach."""
    dim = a.ints.shape[1]
    slack = 1e-9 + 8 * (dim + 4) * np.finfo(float).eps * a.norm[:, None] * r.norm[None, :]
    part, done, alive = np.zeros((len(a.norm), len(r.norm))), 0, allowed
    for step, m in enumerate(a.steps):
        part += a.turned[:, done:m] @ r.turned[:, done:m].T
        done = m
        reach = a.left[step][:, None] * r.left[step][None, :] * (1 + 1e-9) + slack
        least, most = part - reach, part + reach
        wanted = np.zeros_like(alive)
        for w in range(low.shape[1]):
            inside = np.where(alive & (most <= high[:, w, None]), least, -np.inf)
            low[:, w] = np.maximum(low[:, w], _largest(inside, k))
            wanted |= (most >= low[:, w, None]) & (least <= high[:, w, None])
        alive = alive & wanted
        if not alive.any():
            break
    i, j = np.nonzero(alive)
    score = np.empty(len(i), np.int64)
    for at in range(0, len(i), each := max(1, PART // max(1, dim))):
        score[at : at + each] = (a.ints[i[at : at + each]] * r.ints[j[at : at + each]]).sum(axis=1)
    return i, j, score


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first of each slot, by score from the highest and then by id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return order[nth < k]


_FOUND = "key long, window int, id long, row long, score long"


def _search(turns: dict[int, np.ndarray], same: bool, k: int):
    """For pairs of blocks: of each anchor's windows the k best rows of its label, or of others, in this task."""

    def run(batches):
        side = no = None
        slot = score = ids = own_row = low = high = keys = None

        def told():
            return pa.RecordBatch.from_arrays([pa.array(keys[slot // low.shape[1]]), pa.array((slot % low.shape[1]).astype(np.int32)), pa.array(ids), pa.array(own_row), pa.array(score)], ["key", "window", "id", "row", "score"])

        for b in batches:
            for at in range(b.num_rows):
                get = lambda n: b.column(n)[at].as_py()  # noqa: B023, E731
                dim = get("dim")
                if get("a_no") != no:
                    if no is not None:
                        yield told()
                    no, keys, labels = get("a_no"), np.array(get("a_keys"), np.int64), np.array(get("a_labels"), np.int64)
                    side = _Side(get("a_vs"), len(keys), dim, turns.get(dim))
                    slot, score, ids, own_row = (np.zeros(0, np.int64) for _ in range(4))
                    if same:
                        low, high = np.full((len(keys), 1), -np.inf), np.full((len(keys), 1), np.inf)
                    else:
                        window = [np.array(get(f"a_{x}s"), np.int64).reshape(len(keys), -1) for x in ("low", "high")]
                        shut = window[0] > window[1]
                        low, high = np.where(shut, np.inf, window[0]), np.where(shut, -np.inf, window[1])
                their, n_ids, n_rows = (np.array(get(f"r_{x}"), np.int64) for x in ("labels", "ids", "keys"))
                rows = _Side(get("r_vs"), len(their), dim, turns.get(dim))
                allowed = (labels[:, None] == their[None, :]) == same
                i, j, found = _scores(side, rows, allowed, low, high, k)
                if same:
                    fresh = [(i, found, n_ids[j], n_rows[j])]
                else:
                    fresh = []
                    for w in range(low.shape[1]):
                        own = (found >= window[0][i, w]) & (found <= window[1][i, w])
                        fresh.append((i[own] * low.shape[1] + w, found[own], n_ids[j[own]], n_rows[j[own]]))
                slot, score, ids, own_row = (np.concatenate([x, *(f[n] for f in fresh)]) for n, x in enumerate((slot, score, ids, own_row)))
                held = _best(slot, score, ids, k)
                slot, score, ids, own_row = slot[held], score[held], ids[held], own_row[held]
                full = np.flatnonzero(np.bincount(slot, minlength=low.size) == k)
                last = np.searchsorted(slot, full, side="right") - 1  # slots are in order
                low.reshape(-1)[full] = np.maximum(low.reshape(-1)[full], score[last])
        if no is not None:
            yield told()

    return run


def mined(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Anchors: rows whose vec_id ``every`` divides.
    Negatives: of other labels, between ``low`` and ``high`` hundredths of the positive's score."""
    all_rows = written(integers(rows, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    nth = F.row_number().over(Window.partitionBy("dim", "label", "v").orderBy(F.col("vec_id").asc_nulls_last()))
    shown = _blocks(all_rows.withColumn("nth", nth).where(F.col("nth") <= positives + 1).withColumn("key", F.col("row")), ROWS, "row-blocks")
    asking = all_rows.where(F.col("vec_id") % every == 0)
    kinds = written(asking.select("dim", "label", "v").distinct().withColumn("key", F.monotonically_increasing_id()), "anchor-kinds")
    turns = rotations(all_rows)
    anchors = _blocks(kinds.withColumn("vec_id", F.col("key")), ANCHORS, "anchor-blocks")

    top = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    near = _paired(anchors, shown, [], True).mapInArrow(_search(turns, True, positives + 1), _FOUND)
    near = written(near.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= positives + 1).select("key", (F.col("nth") - 1).alias("window"), "row", F.col("id").alias("positive"), F.col("score").alias("p_score")), "positives")
    # The whole scores of each window; one that has none is shut: its low end is above its high one.
    ends = near.selectExpr("key", "window", f"-((-p_score * {low} - pmod(-p_score * {low}, 100)) div 100) AS lo", f"(p_score * {high} - pmod(p_score * {high}, 100)) div 100 AS hi")
    by_key = ends.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("lo", "hi")))).alias("ends"))  # positives + 1 at most
    windows = range(positives + 1)
    end = lambda w, x, closed: F.coalesce(F.try_element_at("ends", F.lit(w))[x], F.lit(closed).cast("long"))
    by_key = by_key.select("key", F.array(*(end(w, "lo", 1) for w in windows)).alias("lo"), F.array(*(end(w, "hi", 0) for w in windows)).alias("hi"))
    spread = anchors.select("no", F.posexplode("keys").alias("at", "key")).join(by_key, "key")
    sets = spread.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("s")).select("no", F.flatten("s.lo").alias("lows"), F.flatten("s.hi").alias("highs"))  # ANCHORS at most
    second = written(anchors.join(sets, "no"), "anchor-windows")
    best = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    far = _paired(second, shown, ["lows", "highs"], False).mapInArrow(_search(turns, False, negatives), _FOUND)
    far = written(far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("key", "window", "rank", F.col("id").alias("negative"), F.col("score").alias("n_score")), "negatives")
    dropped(shown, anchors, second)
    return _told(asking, kinds, near, far, positives)


def _told(asking: DataFrame, kinds: DataFrame, near: DataFrame, far: DataFrame, positives: int) -> DataFrame:
    """Of each anchor's positives the first that aren't the anchor itself, with their negatives."""
    lists = far.groupBy("key", "window").agg(F.array_sort(F.collect_list(F.struct("rank", "negative", "n_score"))).alias("negs"))
    found = near.join(lists, ["key", "window"], "left")  # a positive without negatives counts among the first, though it has no rows
    by_key = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("window", "row", "positive", "p_score", "negs"))).alias("ps"))
    ask = asking.select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("own"), "dim", "label", "v").join(kinds, ["dim", "label", "v"]).select("anchor_id", "own", "key")
    first = F.slice(F.filter("ps", lambda p: p["row"] != F.col("own")), 1, positives)
    out = ask.join(by_key, "key").select("anchor_id", F.explode(first).alias("p")).select("anchor_id", "p", F.explode("p.negs").alias("n"))
    shown = lambda c: F.nullif(F.col(c), F.lit(_LAST))
    return out.select("anchor_id", shown("p.positive").alias("positive_id"), F.col("n.rank").alias("rank"), shown("n.negative").alias("negative_id"), F.col("p.p_score").alias("positive_score"), F.col("n.n_score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are the next ones."""
    rows = table(spark, sf_dir, "embeddings")
    return mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
  n AS (SELECT p.anchor_id, positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
  SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
