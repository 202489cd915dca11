"""Duplicates and conflicts within a user's memories: joins, resolution, and the ordered fold of a batch of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrywell.functions.text import NEGATIONS, OPPOSITES, key_words, tokens
from quarrywell.operators.nearness import SAMPLE, linked, near_ids, near_pairs, near_said, written
from quarrywell.schema import DELETED, RECORD

FIELDS = [f.name for f in RECORD.fields]
#: Rows of a user, and bytes of their texts and vectors, up to which they are folded in one task.
MOST, MOST_BYTES = 20_000, 64 << 20
#: What is folded together: a group of users is held whole by a task's Python, several times over.
GROUP, GROUP_BYTES = 2_000, 4 << 20
#: Words that decide whether two texts can say opposite things; how many of the commonest key words a mark tells.
SAYS = list(dict.fromkeys([*NEGATIONS, *(w for p in OPPOSITES for w in p)]))
COMMON = 256

#: The record, and the ids of the new rows that it now holds.
FOLDED = T.StructType([*RECORD.fields, T.StructField("sources", T.ArrayType(T.StringType()))])


def duplicates(new: DataFrame, existing: DataFrame, threshold: float = 0.85, before: bool = False, scratch: list[str] | None = None, first: bool = False) -> DataFrame:
    """new_id, old_id, sim, old_seq: above the threshold, unless the two say the opposite of each other.  ``before``: only pairs whose
    existing row comes first.  ``first``: of each new row no more of them than tell its first in store order.

    No pair carries words: a row's mark tells which words of ``SAYS`` it has, and which of the commonest key words.  Pairs that say
    opposite things share a key word for sure if it is one of those; the others meet hashes of their key words, and only those that
    share one of these meet the words."""
    scratch = [] if scratch is None else scratch
    mine = written(_worded(new), "near-words", scratch)
    theirs = mine if existing is new else written(_worded(existing), "near-words", scratch)
    common = {w: k for k, w in enumerate(_common(mine))}
    left = _marked(mine, common)
    right = left if theirs is mine else _marked(theirs, common)
    near = written(near_said(left, right, threshold, _verdict, before, first, scratch), "near-said", scratch)
    sure, asked = near.where("sure"), near.where("NOT sure")
    if first:
        sure = sure.groupBy("new_id").agg(F.min_by(F.struct("user_id", "old_id", "sim", "new_seq", "old_seq"), _place()).alias("p")).select("new_id", "p.*")
        asked = asked.join(sure.select("new_id", _place().alias("least")), "new_id", "left").where(F.col("least").isNull() | (_place() < F.col("least")))
    pair = ["user_id", "new_id", "old_id", "sim", "new_seq", "old_seq"]
    shared = lambda df, of: df.select(*pair).join(mine.select(F.col("memory_id").alias("new_id"), of.alias("x")), "new_id").join(theirs.select(F.col("memory_id").alias("old_id"), of.alias("y")), "old_id").select(*pair, F.arrays_overlap("x", "y").alias("shared"))
    asked = written(shared(asked, F.transform("words", lambda w: F.hash(w))), "near-asked", scratch)
    return sure.select(*pair).unionAll(asked.where("NOT shared").select(*pair)).unionAll(shared(asked.where("shared"), F.col("words")).where("NOT shared").select(*pair))


def _place() -> Column:
    return F.struct(F.col("old_seq").isNull(), F.col("old_seq"), F.col("old_id"))


def _worded(rows: DataFrame) -> DataFrame:
    """The rows that have a text, with its key words and ``says``: a bit for a negation, one for each side of each pair of opposites."""
    said = rows.where("content IS NOT NULL").select("memory_id", "user_id", "seq", "embedding", tokens("content").alias("tokens"))
    said = said.select("memory_id", "user_id", "seq", "embedding", key_words(F.col("tokens")).alias("words"), F.array_intersect("tokens", F.array(*map(F.lit, SAYS))).alias("some"))
    bits = [F.arrays_overlap("some", F.array(*map(F.lit, NEGATIONS))), *(F.array_contains("some", p[side]) for side in (0, 1) for p in OPPOSITES)]
    says = sum((F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)) for k, hit in enumerate(bits)), F.lit(0)).cast("long")
    return said.select("memory_id", "user_id", "seq", "embedding", "words", says.alias("says"))


def _common(worded: DataFrame) -> list[str]:
    """The commonest key words of some rows of a written table.  They decide which pairs meet their words, never what those say."""
    some = worded.where(F.pmod(F.xxhash64("memory_id"), F.lit(max(1, worded.count() // SAMPLE))) == 0)
    found = some.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in found.orderBy(F.desc("n"), "w").limit(COMMON).collect()]


def _marked(worded: DataFrame, common: dict[str, int]) -> DataFrame:
    """The rows with ``mark``: says, and a bit for each common word."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            mark = np.zeros((b.num_rows, 1 + COMMON // 64), "<u8")
            mark[:, 0] = b.column(4).to_numpy()
            for k, words in enumerate(b.column(5).to_pylist()):
                at = np.array([common[w] for w in words], int)
                np.bitwise_or.at(mark[k], 1 + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([m.tobytes() for m in mark], pa.binary())], ["memory_id", "user_id", "seq", "embedding", "mark"])

    some = F.array_intersect("words", F.array(*map(F.lit, common)).cast("array<string>"))
    kind = T.StructType([*worded.select("memory_id", "user_id", "seq", "embedding").schema.fields, T.StructField("mark", T.BinaryType())])
    return worded.select("memory_id", "user_id", "seq", "embedding", "says", some.alias("some")).mapInArrow(run, kind)


def _verdict(x, y):
    """Of pairs of marks: 0 if they share a common key word and say opposite things, 2 if they only say such, else 1."""
    import numpy as np

    x, y = (np.ascontiguousarray(m).view("<u8") for m in (x, y))
    a, b, n = x[:, 0], y[:, 0], np.uint64(len(OPPOSITES))
    side = np.uint64((1 << len(OPPOSITES)) - 1)
    sides = lambda s: ((s >> np.uint64(1)) & side, s >> (np.uint64(1) + n))
    (ap, an), (bp, bn) = sides(a), sides(b)
    opposed = (((a ^ b) & np.uint64(1)) | (ap & bn) | (an & bp)) != 0
    shared = (x[:, 1:] & y[:, 1:]).any(axis=1)
    return np.where(opposed, np.where(shared, 0, 2), 1)


def conflicts(new: DataFrame, existing: DataFrame, low: float = 0.65, high: float = 0.85, before: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """new_id, old_id, sim strictly between the two thresholds."""
    return near_pairs(new, existing, low, high, before, scratch)


def first_duplicates(found: DataFrame) -> DataFrame:
    """new_id, old_id: the first in store order of each new row's duplicates.  Summed up inside each task first."""
    return found.groupBy("new_id").agg(F.min_by("old_id", _place()).alias("old_id"))


def resolve(new: DataFrame, existing: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The rewritten rows: content and tags of the new row, all else of the existing one, accessed now."""
    n = new.select(F.col("memory_id").alias("new_id"), F.col("content").alias("new_content"), F.col("tags").alias("new_tags"))
    out = existing.join(first_duplicates(found).select("new_id", "old_id"), F.col("memory_id") == F.col("old_id")).join(n, "new_id")
    return out.withColumns({"content": F.col("new_content"), "tags": F.col("new_tags"), "last_accessed_at": now}).drop("new_id", "old_id", "new_content", "new_tags")


def in_conflict(new: DataFrame, existing: DataFrame, low: float = 0.65, high: float = 0.85, before: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """new_id of the rows that have a conflict, each once; the pairs are never written out."""
    return near_ids(new, existing, low, high, before, scratch)


def flag_conflicts(new: DataFrame, found: DataFrame) -> DataFrame:
    """new with ``conflict_flagged`` set in the metadata of rows that have a conflict."""
    hit = found.select(F.col("new_id").alias("memory_id")).distinct().withColumn("hit", F.lit(True))
    return new.join(hit, "memory_id", "left").withColumn("metadata", F.when(F.col("hit"), flagged(F.col("metadata"))).otherwise(F.col("metadata"))).drop("hit")


def flagged(metadata: Column) -> Column:
    """The JSON object with ``conflict_flagged`` true; all other values keep their types."""
    entries = F.map_filter(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"), lambda k, v: k != "conflict_flagged")
    return F.to_json(F.map_concat(entries, F.create_map(F.lit("conflict_flagged"), F.parse_json(F.lit("true")))))


def _python_tokens(text: str) -> list[str]:
    return text.lower().split()


def _python_key_words(words: list[str]) -> set[str]:
    from quarrywell.functions.text import PREPOSITIONS, PUNCTUATION

    out, opened = set(), False
    for w in words:
        taken = opened and w in PREPOSITIONS
        bare = w.strip(PUNCTUATION)
        if taken or len(bare) > 2:
            out.add(bare)
        opened = not taken
    return out


def _python_flip(a: str, b: str) -> bool:
    from quarrywell.functions.text import NEGATIONS, OPPOSITES

    x, y = _python_tokens(a), _python_tokens(b)
    if not _python_key_words(x) & _python_key_words(y):
        return False
    u, v = set(x), set(y)
    pair = any((p in u and n in v) or (n in u and p in v) for p, n in OPPOSITES)
    return pair or bool(u & set(NEGATIONS)) != bool(v & set(NEGATIONS))


def remember_many(new: DataFrame, existing: DataFrame, now, threshold: float = 0.85, low: float = 0.65) -> DataFrame:
    """The rows to store after writing ``new`` in order of seq, each seeing the writes before it."""
    return folded(new, existing, now, threshold, low).drop("sources")


def folded(new: DataFrame, existing: DataFrame, now, threshold: float = 0.85, low: float = 0.65, most: int = MOST, scratch: list[str] | None = None) -> DataFrame:
    """The rows to store, each with ``sources``: the ids of the new rows that it holds, itself or merged into it.

    A row whose first duplicate in store order exists rewrites it; another is inserted, flagged if it has conflicts.  Users with up to
    ``most`` rows and ``MOST_BYTES`` are folded in one task each, a few users together by rows and bytes; larger ones by ``folded_apart``,
    with the same results."""
    new = new.select(*FIELDS)
    live = existing.where(F.col("lifecycle_state") != DELETED).select(*FIELDS)
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + 8 * F.coalesce(F.array_size("embedding"), F.lit(0))
    asked = new.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    live = live.join(asked.select("user_id"), "user_id", "left_semi")
    sizes = live.groupBy("user_id").agg(F.count("*").alias("m"), F.sum(size).alias("more"))
    each = asked.join(sizes, "user_id", "left").select("user_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), (F.col("bytes") + F.coalesce("more", F.lit(0))).alias("bytes"))
    large = (F.col("n") > most) | (F.col("bytes") > MOST_BYTES)
    hot, total = each.where(large).select("user_id"), each.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(large).alias("hot")).first()
    groups = max(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["n"] or 0) // GROUP, (total["bytes"] or 0) // GROUP_BYTES)
    if not total["hot"]:
        return _folded_alone(new, live, now, threshold, low, groups)
    pick = lambda df, how: df.join(hot, "user_id", how).select(*FIELDS)
    return _folded_alone(pick(new, "left_anti"), pick(live, "left_anti"), now, threshold, low, groups).unionByName(folded_apart(pick(new, "left_semi"), pick(live, "left_semi"), now, threshold, low, scratch))


def folded_apart(new: DataFrame, live: DataFrame, now, threshold: float = 0.85, low: float = 0.65, scratch: list[str] | None = None) -> DataFrame:
    """The fold of users of any size.

    Which rows a new one may be merged into is a matter of vectors alone, and these never change: so the pairs above the threshold are
    found by a distributed join first.  Rows that no such pair links can't touch each other, so the fold goes over the components
    of these pairs, each in store order and with its own pairs only; rows without any are inserted.  A row then has a conflict if one
    that was there, or was inserted before it, lies between the thresholds: a second join, that tells rows and no pairs."""
    scratch = [] if scratch is None else scratch
    rows = lambda df, old: df.select("user_id", "memory_id", "seq", F.lit(old).alias("old"), "content", "tags")
    pairs = near_pairs(new, live, threshold, scratch=scratch).unionAll(near_pairs(new, new, threshold, before=True, scratch=scratch))
    pairs = written(pairs.select("new_id", "old_id"), "fold-pairs", scratch)
    roots = linked(pairs.select(F.col("new_id").alias("u"), F.col("old_id").alias("v")), scratch)
    named = lambda df, c: df.join(roots.withColumnRenamed("node", c), c)
    texts = named(rows(live, True).unionAll(rows(new, False)), "memory_id")
    fates = texts.groupBy("root").cogroup(named(pairs, "new_id").withColumnRenamed("root", "of").groupBy("of")).applyInPandas(_fates, "memory_id string, held_by string, content string, tags array<string>")
    fates = written(fates, "fold-fates", scratch)
    merged = fates.where("held_by IS NOT NULL").select("memory_id")
    stays = new.join(merged, "memory_id", "left_anti")
    last = fates.where("content IS NOT NULL").select("memory_id", F.struct("content", "tags").alias("last"))
    sources = fates.where("held_by IS NOT NULL").groupBy(F.col("held_by").alias("memory_id")).agg(F.collect_list("memory_id").alias("more"))
    hit = near_ids(stays, live, low, threshold, scratch=scratch).unionAll(near_ids(stays, stays, low, threshold, before=True, scratch=scratch))
    inserted = flag_conflicts(stays, hit).withColumn("inserted", F.lit(True))
    rewritten = live.join(last.select("memory_id"), "memory_id", "left_semi").withColumn("inserted", F.lit(False))
    out = inserted.select(*FIELDS, "inserted").unionByName(rewritten.select(*FIELDS, "inserted")).join(last, "memory_id", "left").join(sources, "memory_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "sources": F.concat(F.when(F.col("inserted"), F.array("memory_id")).otherwise(none), F.coalesce("more", none)), "content": F.coalesce("last.content", "content"), "tags": F.when(F.col("last").isNotNull(), F.col("last.tags")).otherwise(F.col("tags")),
        "last_accessed_at": F.when(F.col("last").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_accessed_at")),
    })
    return out.select(*FIELDS, "sources")


def _fates(texts, pairs):
    """Of one component: each merged row with its holder, and each holder with its last content and tags."""
    import pandas as pd

    # Store order: what was there by seq, then what comes in by seq; ties by id, a null seq last.
    texts = texts.assign(at=texts["seq"].fillna(float("inf"))).sort_values(["at", "memory_id"])
    order = {i: k for k, i in enumerate([*texts.loc[texts["old"], "memory_id"], *texts.loc[~texts["old"], "memory_id"]])}
    said = dict(zip(texts["memory_id"], texts["content"]))
    tagged = dict(zip(texts["memory_id"], texts["tags"]))
    may: dict[str, list[str]] = {}
    for a, b in zip(pairs["new_id"], pairs["old_id"]):
        may.setdefault(a, []).append(b)
    holder, changed = {}, {}
    for i in texts.loc[~texts["old"], "memory_id"]:
        at = next((o for o in sorted(may.get(i, []), key=order.get) if o not in holder and not _python_flip(said[i], said[o])), None)
        if at is not None:
            holder[i], changed[at], said[at] = at, tagged[i], said[i]
    out = [(i, h, None, None) for i, h in holder.items()] + [(i, None, said[i], t) for i, t in changed.items()]
    return pd.DataFrame(out, columns=["memory_id", "held_by", "content", "tags"])


def _folded_alone(new: DataFrame, live: DataFrame, now, threshold: float, low: float, groups: int) -> DataFrame:
    """Each user's fold in one task, users dealt to ``groups``."""
    import numpy as np
    import pandas as pd

    columns = FIELDS
    stamp = pd.Timestamp(now)

    def fold(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        # Users with nothing but one new row have nothing to fold.
        lone = rows["user_id"].notna() & ~rows["user_id"].duplicated(keep=False) & ~rows["user_id"].isin(old["user_id"])
        single = rows.loc[lone, columns]
        known, out = dict(list(old.groupby("user_id", dropna=False))), [single.assign(sources=[[i] for i in single["memory_id"]])] if len(single) else []
        for user, own in rows[~lone].groupby("user_id", dropna=False):
            out.append(fold_one(known.get(user, old.iloc[:0]), own))
        return pd.concat(out) if out else pd.DataFrame([], columns=[*columns, "sources"])

    def fold_one(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        import json

        old, rows = old.sort_values("seq"), rows.sort_values("seq")
        store = [dict(zip(columns, r)) for r in old[columns].itertuples(index=False)]
        dims = [len(x) for x in [*old["embedding"], *rows["embedding"]] if x is not None]
        dim, total = (dims[0] if dims else 1), len(old) + len(rows)
        unit, there, held, changed = np.zeros((total, dim)), np.zeros(total, bool), len(store), {}
        sources: dict[int, list[str]] = {}

        def put(at, x):
            if x is not None and len(x) == dim:
                v = np.asarray(x, float)
                size = np.sqrt((v * v).sum())
                unit[at], there[at] = (v / size if size > 0 and np.isfinite(size) else 0.0), True

        for k, r in enumerate(store):
            put(k, r["embedding"])
        for r in rows[columns].itertuples(index=False):
            row = dict(zip(columns, r))
            put(held, row["embedding"])
            near = (unit[:held] @ unit[held] + 1) / 2 if there[held] else np.zeros(held)
            live = there[:held] & there[held]
            match = next((k for k in np.flatnonzero(live & (near > threshold)).tolist() if not _python_flip(row["content"], store[k]["content"])), None)
            if match is not None:
                there[held] = False
                store[match] = store[match] | {"content": row["content"], "tags": row["tags"], "last_accessed_at": stamp}
                changed[match] = store[match]
                sources.setdefault(match, []).append(row["memory_id"])
                continue
            if (live & (near > low) & (near < threshold)).any():
                kept = {k: v for k, v in json.loads(row["metadata"] or "{}").items() if k != "conflict_flagged"}
                row["metadata"] = json.dumps(kept | {"conflict_flagged": True}, separators=(",", ":"), ensure_ascii=False)
            store.append(row)
            changed[held] = row
            sources[held] = [row["memory_id"]]
            held += 1
        return pd.DataFrame([r | {"sources": sources[k]} for k, r in changed.items()], columns=[*columns, "sources"])

    group = lambda df: df.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("of"))
    return group(live).cogroup(group(new)).applyInPandas(fold, FOLDED)
