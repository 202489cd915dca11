"""Filter interaction audit by a trie of all orders of some filters.

Whether a document fails a filter is told from its whole text once, and kept with its part and labels as a short row.  Then
the trie of orders is walked depth first: a node is the DataFrame of the documents that the filters so far have left,
persisted while its branches are walked; an edge applies one more filter to it.  Orders that begin with the same
filters in another sequence leave the same documents, so nodes are memoised by the set of filters: n filters have
2**n nodes and n * 2**(n-1) edges, not n! orders.  One pass over a node's documents counts, for each part, what every edge from
there removes; nothing is worked out from other nodes' counts.  Each order's steps are then looked up.

A node that is lost with its executor is filtered anew from the written short rows.  Counts are summed inside tasks before
they are shuffled, so a part with most of the documents is no burden; parts are never collected.

Defined results: a null text is empty, a null source is the part ''.  A null doc_id is smaller than none and has no
labels; rows that repeat a doc_id and text are documents of their own and no copies of each other.  Labels of one document
in several rows: 1 if any says so.  Texts are held to be identical by SHA-256.  An empty table has no parts and gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import dropped, fresh_path, table, written

FILTERS, MARKS, MOST = ("A", "B", "C", "D", "E"), ("good", "toxic"), 8
SPACE = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: fails), good, toxic of each document; a written table."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = text.select("doc_id", "part", "t", F.array_remove(F.split("t", SPACE, -1), "").alias("w"))
    counted = split.select("doc_id", "part", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("kinds"), F.regexp_count("t", F.lit("[A-Z]")).alias("upper"), F.length("t").alias("chars"), F.col("t").rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2("t", 256)).alias("digest"))
    long = lambda c: F.col(c).cast("long")
    base = written(counted.select("doc_id", "part", (F.col("n") < 50).alias("A"), (long("kinds") * 100 < long("n") * 65).alias("B"), (long("upper") * 100 > long("chars") * 5).alias("C"), "D", "digest"), "audit-texts")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = written(first, "audit-copies")  # a plain table: the join can then split the rows of a text that very many documents have
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    marks = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(m).alias(m) for m in MARKS))
    rows = base.join(first, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).join(marks, "doc_id", "left")
    out = written(rows.select("part", *FILTERS, *(F.coalesce(m, F.lit(False)).alias(m) for m in MARKS)), "audit-rows")
    dropped(base, first)
    return out


def walked(rows: DataFrame, filters=FILTERS, marks=MARKS) -> DataFrame:
    """part, kept, state (bits of the filters that have been applied), edges (of each filter what it removes there: all
    documents, and those with each mark; nothing where it has been applied); one written table, a folder for each state."""
    if len(filters) > MOST:
        raise ValueError(f"{MOST} filters at most: the states double with each")
    spark, known = rows.sparkSession, set()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    edge = lambda f: F.struct(n(F.col(f)).alias("removed"), *(n(F.col(f) & F.col(m)).alias(m) for m in marks))
    path, files = fresh_path(spark, "audit-states"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) >> len(filters))  # all states together as many as any shuffle

    def visit(state: int, alive: DataFrame) -> None:
        alive = alive.persist(StorageLevel.MEMORY_AND_DISK)
        counts = alive.groupBy("part").agg(F.count("*").alias("kept"), F.array(*map(edge, filters)).alias("edges"))
        counts.coalesce(files).write.parquet(f"{path}/state={state}")
        known.add(state)
        for k, f in enumerate(filters):
            if state | 1 << k not in known:
                visit(state | 1 << k, alive.where(~F.col(f)))
        alive.unpersist()

    visit(0, rows)
    return spark.read.schema(counted_as(marks)).parquet(path)


def counted_as(marks=MARKS) -> str:
    return "part string, kept long, edges array<struct<removed: long, " + ", ".join(f"{m}: long" for m in marks) + ">>, state int"


def report(states: DataFrame, filters=FILTERS, marks=MARKS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley: for each part all orders and steps."""
    spark, n = states.sparkSession, len(filters)
    steps = []
    for order in permutations(range(n)):
        gone = 0
        for step, k in enumerate(order, 1):
            steps.append((len(steps), "".join(filters[x] for x in order), step, k, gone, gone | 1 << k, 2**n - 1 - (1 << k)))
            gone |= 1 << k
    orders = spark.createDataFrame(steps, "at int, filter_order string, step int, f int, before int, after int, others int")  # n * n! rows
    edge = F.transform("edges", lambda e, f: F.struct((F.col("state") * n + f).alias("k"), e.alias("v")))
    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", "kept"))).alias("kept_in"), F.map_from_entries(F.flatten(F.collect_list(edge))).alias("edge_of"))  # 2**n states a part
    removed = lambda state, f, what="removed": F.coalesce(F.try_element_at("edge_of", state * n + f)[what], F.lit(0).cast("long"))
    share = lambda f: sum((F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * removed(F.lit(s), F.lit(f)) for s in range(2**n) if not s >> f & 1), F.lit(0).cast("long"))
    parts = parts.withColumn("shares", F.array(*map(share, range(n)))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = parts.join(F.broadcast(orders), "at")
    f, before = F.col("f"), F.col("before")
    return rows.select(
        "part", "filter_order", "step", F.coalesce(F.try_element_at("kept_in", F.col("after")), F.lit(0).cast("long")).alias("kept"), removed(before, f).alias("removed"), (removed(F.lit(0), f) - removed(before, f)).alias("redundant"),
        removed(F.col("others"), f).alias("unique_fails"), *(removed(before, f, m).alias(f"{m}_lost") for m in marks), F.get("shares", f).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = failures(docs, labels)
    states = walked(rows)
    dropped(rows)
    out = written(report(states), "audit")
    dropped(states)
    return out


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
  s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
  r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, translate(fails, before, '') <> fails AS gone, fails = f AS alone FROM c, s),
  t AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
  SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t"""
