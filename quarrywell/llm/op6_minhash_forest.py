"""MinHash near-dedup with an LSH forest.

Documents with the same set of word shingles are one class.  A class has ``HASHES`` MinHash values; each of ``TREES``
orders sorts the classes by ``LEVELS`` of them, read in its own permutation.  The sequence of all orders is dealt by ranges,
and what stands at the ends of a range is compared with its neighbours in one more step, so no region is one task's.

Neighbours in an order are candidates by the length of their common prefix, at least ``DEPTH`` values.  How deep depends on
the region: a class meets all others of its region of ``DEPTH`` values if these are ``SMALL`` at most; else the region is
deepened, value by value, until what is left of it around the class is as small; where even the deepest is larger, the
class meets the next ``NEAR``.

Candidates are confirmed on the full shingle sets.  First the best partner of each class (the one met in most orders) is
tried, then all candidates that the components found so far don't join already.  Regions of more than ``SMALL`` classes
that are still in several components are gone through once more: the classes outside a region's largest component meet all
its classes, in blocks bounded by their number and bytes, and the pairs that their signatures don't rule out (five standard
deviations, which loses less than one such link in a million) are confirmed as well, inside the task.  So dense regions
lose no link to deeper prefixes.

With similarity s an order brings two classes into one region with probability s ** DEPTH; at s = 0.8 all of them fail with
probability (1 - 0.8 ** 4) ** 40 < 1e-9, as no two orders begin with the same values.

Defined results: A-Z are lower-cased; words are separated by space and U+0009 to U+000D; fewer words than a shingle
are one shingle; texts without words, null ones too, have empty sets and link with nothing; equal rows are one class;
rows with a null id belong to their class without naming it; an empty table gives an empty result; other columns are
ignored (``one_of_each`` returns them all).  A class is known by 64 bits of its digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import dropped, table, written
from quarrywell.llm.components import components
from quarrywell.llm.wordhash import Words, by_bytes, mixed

WORDS, PERCENT = 4, 80
TREES, DEPTH, LEVELS, SMALL, NEAR = 40, 4, 8, 8, 3
HASHES, BLOCK, BLOCK_BYTES = TREES * DEPTH, 256, 16 << 20


def _draw(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_A, _B = _draw(6, HASHES), _draw(66, HASHES)
_HEADS = np.random.default_rng(1000).permutation(HASHES).reshape(TREES, DEPTH)  # each value heads one order
_ORDERS = np.stack([np.concatenate([h, np.random.default_rng(1001 + t).permutation(np.setdiff1d(np.arange(HASHES), h))[: LEVELS - DEPTH]]) for t, h in enumerate(_HEADS)])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    grams = w.grams(words)
    out = []
    for first, after in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if after - first >= words:
            own = grams[first : after - words + 1]
        else:
            own = w.runs(np.array([first]), np.array([after])) if after > first else grams[:0]
        out.append(np.unique(own.view(np.uint64)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits."""
    best = np.full(HASHES, np.uint64(2**64 - 1), np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[k : k + 1024, None] * _A + _B).min(axis=0), out=best)
    return (mixed(best) & np.uint64(0xFFFF)).astype(">u2")


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _text_key():
    """With the id it tells a row's text from those of other rows."""
    return F.md5(F.col("text").cast("string").cast("binary"))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, cid (its class; null if the set is empty), n_shingles, sig."""

    def run(batches):
        for batch in batches:
            for some, texts in by_bytes(batch, 2):
                sets = shingle_sets(texts, words)
                cid = [_digest(s) if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(cid, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_key", "cid", "n_shingles", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key string, cid long, n_shingles long, sig binary")


def _forest(classes: DataFrame) -> DataFrame:
    """tree, prefix, rest, cid: a class's place in each order; the prefix holds DEPTH values, the rest those behind them."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, HASHES)
            key = np.ascontiguousarray(sig[:, _ORDERS.ravel()]).view(">i8").reshape(n * TREES, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], ["tree", "prefix", "rest", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "tree int, prefix long, rest long, cid long")


def neighbours(tree: np.ndarray, prefix: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the candidates in a sorted part of the orders."""
    n = len(tree)
    rows = np.arange(n)
    same = np.concatenate([[False], (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])]) if n else np.empty(0, bool)
    differ = np.concatenate([np.zeros(1, np.uint64), (rest[1:] ^ rest[:-1]).view(np.uint64)]) if n else np.empty(0, np.uint64)
    end = np.minimum(rows + 1 + NEAR, n)  # the places after those that each row meets
    found = np.zeros(n, bool)
    for extra in range(LEVELS - DEPTH + 1):
        # A new region begins where the common prefix with the row before is shorter than DEPTH + extra values.
        shared = same if not extra else same & (differ >> np.uint64(64 - 16 * extra) == 0)
        start = np.flatnonzero(~shared)
        size = np.diff(np.append(start, n))
        if not extra:
            end = np.minimum(end, np.repeat(start + size, size))
        fits = ~found & np.repeat(size <= SMALL, size)
        end[fits] = np.repeat(start + size, size)[fits]
        found |= fits
    count = end - rows - 1
    i = np.repeat(rows, count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def candidates(classes: DataFrame) -> DataFrame:
    """u < v, n: pairs of classes that are neighbours in some order, and in how many."""
    places = ["tree", "prefix", "rest", "cid"]

    def run(batches):
        from pyspark import TaskContext

        part, left = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            if left is None:  # the first rows are neighbours of the range before
                head = [r[:SMALL] for r in rows]
                yield told(head[3], head[3] * 0, head, part)
            known = 0 if left is None else len(left[0])
            rows = [np.concatenate(x) for x in zip(left, rows)] if known else rows
            yield from pairs(rows, known)
            left = [r[-SMALL:] for r in rows]
        if left is not None:
            yield told(left[3], left[3] * 0, left, part)

    def pairs(rows, known):
        """The first ``known`` rows are those carried over from the batch before."""
        i, j = neighbours(*rows[:3])
        i, j = i[j >= known], j[j >= known]
        for k in range(0, len(i), 1 << 18):
            yield told(rows[3][i[k : k + (1 << 18)]], rows[3][j[k : k + (1 << 18)]], None, None)

    def told(u, v, edge, part):
        none = np.ones(len(u), bool) if edge is None else np.zeros(len(u), bool)
        own = edge or [np.zeros(len(u), np.int32), u * 0, u * 0, u]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v) if edge is None else u), pa.array(np.maximum(u, v) if edge is None else v), pa.array(own[0], pa.int32(), mask=none), pa.array(own[1]), pa.array(own[2]), pa.array(np.full(len(u), part or 0, np.int32))], ["u", "v", "tree", "prefix", "rest", "part"])

    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _forest(classes).repartitionByRange(parts, *places).sortWithinPartitions(*places)
    found = written(order.mapInArrow(run, "u long, v long, tree int, prefix long, rest long, part int"), "neighbours")
    inner = found.where("tree IS NULL").select("u", "v")

    def across(batches):
        rows = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches if b.num_rows))]
        if rows:
            i, j = neighbours(*rows[:3])
            apart = rows[4][i] != rows[4][j]
            u, v = rows[3][i[apart]], rows[3][j[apart]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    # The ends of the ranges: 2 * SMALL rows of each at most.
    edges = found.where("tree IS NOT NULL").select("tree", "prefix", "rest", F.col("u").alias("cid"), "part").distinct()
    edges = edges.repartition(1).sortWithinPartitions(*places, "part").mapInArrow(across, "u long, v long")
    out = written(inner.unionByName(edges).where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n")), "candidates")
    dropped(found)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, shingles of the classes in ``wanted`` (doc_id and text_key of one member, cid)."""

    def run(batches):
        for batch in batches:
            for some, texts in by_bytes(batch, 1):
                sets = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    found = rows.join(wanted.select("cid", "member", F.col("member_key")), (rows["text_key"] == F.col("member_key")) & rows["doc_id"].eqNullSafe(F.col("member"))).select("cid", "text")
    return found.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns[2:4])
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["u", "v"])

    left = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components; a class without one is its own."""
    a = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)").select(*pairs.columns)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    both = int((merged[1:] == merged[:-1]).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _dense(classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links between classes that share a region too large to have been gone through whole and that are still
    in different components.

    In each such region the classes outside its largest component meet all its classes, block by block.  Pairs whose
    signatures rule a link out are passed over, others are confirmed on their full sets inside the task; a pair is looked
    at once, in the first order that brings it together, and one link from a class to a component is enough there.  The
    classes of a region are dealt to blocks by a hash, so no region is sorted or numbered in one task."""
    held = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "sig", "n_shingles", F.coalesce("component", "cid").alias("component"))
    placed = written(_forest(held).drop("rest").join(held.select("cid", "component", "n_shingles"), "cid"), "placed")
    sizes = placed.groupBy("tree", "prefix", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).groupBy("tree", "prefix").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("parts"), F.max_by(F.struct("component", "n", "m"), F.struct("n", "component")).alias("main"))
    blocks_of = lambda n, m: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(m * 8 / BLOCK_BYTES)).cast("int")
    mixed_ = sizes.where((F.col("n") > SMALL) & (F.col("parts") > 1)).select(
        "tree", "prefix", F.col("main.component").alias("main"), blocks_of(F.col("main.n"), F.col("main.m")).alias("inside"), blocks_of(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m")).alias("outside"))
    mixed_ = written(mixed_, "mixed-regions")
    rows = placed.join(mixed_, ["tree", "prefix"]).withColumn("in_main", F.col("component") == F.col("main"))
    blocked = written(rows.select("tree", "prefix", "cid", "component", "in_main", F.pmod(F.xxhash64("cid"), F.when(F.col("in_main"), F.col("inside")).otherwise(F.col("outside"))).alias("block")), "region-rows")
    whole = blocked.join(held.select("cid", "sig"), "cid").join(sets, "cid")
    blocks = whole.groupBy("tree", "prefix", "in_main", "block").agg(F.collect_list("cid").alias("cid"), F.collect_list("component").alias("component"), F.collect_list("sig").alias("sig"), F.collect_list("shingles").alias("sets"))
    blocks = written(blocks, "region-blocks")
    outer = blocks.where("NOT in_main").select("tree", "prefix", *(F.col(c).alias(f"x_{c}") for c in ("block", "cid", "component", "sig", "sets")))
    pairs = outer.join(blocks, ["tree", "prefix"]).where("in_main OR block >= x_block")
    least = int(HASHES * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5))
    heads = _HEADS

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in ("tree", "x_cid", "x_component", "x_sig", "x_sets", "cid", "component", "sig", "sets")}
                x, y = (np.frombuffer(b"".join(row[c]), ">u2").reshape(-1, HASHES).astype(np.uint16) for c in ("x_sig", "sig"))
                xs, ys = ([np.frombuffer(t, np.uint64) for t in row[c]] for c in ("x_sets", "sets"))
                yc = np.array(row["component"], np.int64)
                u, v = [], []
                for k in range(len(x)):
                    same = (y == x[k]).sum(axis=1)
                    hit = np.flatnonzero((same >= least) & (yc != row["x_component"][k]))
                    hit = hit[np.argsort(-same[hit], kind="stable")]
                    if len(hit):
                        shared = (y[hit][:, heads] == x[k][heads]).all(axis=2)
                        hit = hit[shared.argmax(axis=1) == row["tree"]]
                    met = set()
                    for j in hit.tolist():
                        if yc[j] not in met and _linked(xs[k], ys[j], percent):
                            met.add(yc[j])
                            u.append(row["x_cid"][k])
                            v.append(row["cid"][j])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    out = written(pairs.mapInArrow(run, "u long, v long"), "dense-links")
    dropped(placed, mixed_, blocked, blocks)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the components found so far are the nodes that the new links join.  Both tables go."""
    if links.isEmpty():
        dropped(links)
        return labels
    a = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    over = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    new = components(over).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = new.select(F.col("component").alias("node"), F.col("to").alias("component")).join(labels.select("node"), "node", "left_anti")
    out = written(moved.unionByName(alone), "labels")
    dropped(labels, links, new)
    return out


def _settled(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components once all of ``pairs`` (u, v, n) are confirmed or not: each class's best pair first, then those that
    still lie between components."""
    both = pairs.select(F.col("u").alias("x"), "u", "v", "n").unionAll(pairs.select(F.col("v").alias("x"), "u", "v", "n"))
    # Ties go by a hash of the pair, so that no class is everyone's partner.
    best = both.groupBy("x").agg(F.max_by(F.struct("u", "v"), F.struct("n", F.xxhash64("u", "v"))).alias("p")).select("p.*").distinct()
    best = written(best, "best-pairs")
    links = written(_confirmed(best, sets, percent), "links")
    labels = components(links)
    rest = written(_across(pairs.join(best, ["u", "v"], "left_anti"), labels), "rest-pairs")
    dropped(links, best)
    if not rest.isEmpty():
        labels = _merged(labels, written(_confirmed(rest, sets, percent), "links"))
    dropped(rest)
    return labels


def near_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, cid, component_id of every row."""
    marked = written(signatures(docs, words), "signatures")
    member = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "text_key"))
    classes = marked.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least"), member.alias("m"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.select("cid", F.col("least").alias("member"), F.col("m.text_key").alias("member_key"), "sig", "n_shingles"), "classes")
    pairs = candidates(classes)
    involved = written(pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct().join(classes, "cid"), "involved")
    sets = written(_sets(docs, involved.select("cid", "member", "member_key"), words), "shingles")
    labels = _settled(pairs, sets, percent)
    dropped(pairs)
    labels = _merged(labels, _dense(involved, labels, sets, percent))
    dropped(involved, sets)
    named = classes.select("cid", "member").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    name = written(named.groupBy("component").agg(F.min("member").alias("component_id")), "names")
    by_class = written(named.join(name, "component").select("cid", "component_id"), "classes-named")
    dropped(classes, labels, name)
    out = marked.select("doc_id", "text_key", "n_shingles", "cid").join(by_class, "cid", "left")
    return out.select("doc_id", "text_key", "n_shingles", "cid", F.coalesce("component_id", "doc_id").alias("component_id"))


def minhash_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    out = near_groups(docs, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: of each group of near copies those of the smallest id.  A
    row goes by its own text, whatever other rows of its id do.  Rows with a null id stay where their own group has no id,
    and rows without shingles stay."""
    groups = near_groups(docs, percent, words)
    lost = groups.where("cid IS NOT NULL").where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("qw_id"), F.col("text_key").alias("qw_key")).distinct()
    lost = written(lost, "lost")
    dropped(groups)
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("qw_id")) & (_text_key() == F.col("qw_key"))
    return docs.join(lost, own, "left_anti")


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))
