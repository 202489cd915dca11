"""URL filters by a sort-merge range join.

A url's key is its host's labels from the last to the first, each ended by ``/``, then ``#``, the path, ``#`` and a hash of
the page's id (neither sign can stand in a host or path where the key has it).  All urls that a rule's host covers, so
begin with the rule's own reversed host: they are one interval of the sorted keys, and the intervals of two rules are
nested or apart.

The sorted keys are cut into ranges of about equal numbers of rows; a host, a path or one url that very many pages share
lies in several, as the hash of the id tells its rows apart.  A rule goes to each range that its interval meets (in a
range within one host, only if its path can meet the paths there), the rows of a range are sorted by their keys, and one
sweep keeps the rules whose intervals are open on a stack, by host.  A url takes the longest rule there that its path begins
with.  So each url is shuffled once, as its key and id, whatever the number of rules; a range is held in no memory,
only the open rules are.

Bounds: the cuts come from a sample of ``PER_RANGE`` keys a range, of ``KEY`` characters at most; they decide where rows
go, never what they get.

Defined results: of rules that fit, that of the longest host and path together wins, then that of the longer host; of
rules alike in both, block before allow.  A rule's path is compared as it stands, its host in lower case; a null host is no
rule, a null path fits every path.  A null url, or one without ``://``, has an empty host and path; like every url
that no rule fits it gets the default.  Each row of pages gets a row, repeated or null ids too; an empty table gives
none; no rules: the default for all; other columns are ignored.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.llm.common import table

PER_RANGE, KEY, RANGES = 10, 512, 4
#: The rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_ROW = "range int, key string, page_id long, path string, rule string, verdict string"


def _reversed(host):
    """The labels from the last to the first, each ended by a slash."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _lower(c):
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, key."""
    after = F.regexp_extract(F.col("url").cast("string"), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1), F.regexp_extract(F.col("url").cast("string"), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    host, path = (F.coalesce(x, F.lit("")) for x in after)
    page = F.col("page_id").cast("long")
    return pages.select(page.alias("page_id"), F.concat(_reversed(_lower(host)), F.lit("#"), path, F.lit("#"), F.hex(F.xxhash64(page))).alias("key"))


def ruled(rules: DataFrame) -> DataFrame:
    """key (the reversed host), path, rule, verdict: one row for each host and path."""
    host, path = _lower(F.col("host").cast("string")), F.coalesce(F.col("path").cast("string"), F.lit(""))
    one = rules.where("host IS NOT NULL").groupBy(host.alias("h"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    return one.select(_reversed(F.col("h")).alias("key"), "path", F.concat("h", "path").alias("rule"), "verdict")


def cuts(keys: DataFrame, ranges: int) -> list[str]:
    """The first keys of all ranges but the first, from a sample whose size depends on the number of ranges alone."""
    n = keys.count()
    some = keys.sample(min(1.0, PER_RANGE * ranges / max(1, n)), seed=7).select(F.substring("key", 1, KEY).alias("key"))
    found = sorted(r["key"] for r in some.collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def met(key: str, path: str, at: list[str]) -> list[int]:
    """The ranges that hold urls which a rule may fit."""
    out = []
    for r in range(bisect_right(at, key), bisect_left(at, key[:-1] + "0") + 1):  # "0" follows "/"
        if 0 < r < len(at):
            (low, sign, first), (high, too, end) = at[r - 1].partition("#"), at[r].partition("#")
            if sign and too and low == high and not (path < end and (path >= first or first.startswith(path))):
                continue
        out.append(r)
    return out


def _placed(keys: DataFrame, rules: DataFrame, at: list[str]) -> DataFrame:
    def urls(batches):
        for b in batches:
            r = pa.array([bisect_right(at, k) for k in b.column(1).to_pylist()], pa.int32())
            none = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([r, b.column(1), b.column(0), none, none, none], ["range", "key", "page_id", "path", "rule", "verdict"])

    def spread(batches):
        for b in batches:
            for key, path, rule, verdict in zip(*(c.to_pylist() for c in b.columns)):
                to = met(key, path, at)
                for k in range(0, len(to), 4096):
                    n = len(part := to[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([key] * n), pa.nulls(n, pa.int64()), *(pa.array([x] * n, pa.string()) for x in (path, rule, verdict))], ["range", "key", "page_id", "path", "rule", "verdict"])

    return keys.select("page_id", "key").mapInArrow(urls, _ROW).unionAll(rules.select("key", "path", "rule", "verdict").mapInArrow(spread, _ROW))


def _sweep(default: str):
    def run(batches):
        now, opened = None, []  # opened: key of a host, its rules by path, the lengths of their paths
        for b in batches:
            pages, hosts, paths, rules, verdicts = [], [], [], [], []
            for r, key, page, path, rule, verdict in zip(*(c.to_pylist() for c in b.columns)):
                if r != now:
                    now, opened = r, []
                while opened and not key.startswith(opened[-1][0]):
                    opened.pop()
                if rule is not None:
                    if not opened or opened[-1][0] != key:
                        opened.append((key, {}, []))
                    _, own, lengths = opened[-1]
                    own[path] = (rule, verdict)
                    if len(path) not in lengths:
                        insort(lengths, len(path))
                    continue
                host, path, _ = key.split("#")
                best = (None, default)
                for _, own, lengths in opened:
                    hit = next((own[path[:n]] for n in reversed(lengths) if n <= len(path) and path[:n] in own), None)
                    if hit and len(hit[0]) >= len(best[0] or ""):
                        best = hit
                pages.append(page)
                hosts.append(".".join(reversed(host[:-1].split("/"))))
                paths.append(path)
                rules.append(best[0])
                verdicts.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.  ``rules``: host, path, verdict (allow or block)."""
    keys = keyed(pages)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cuts(keys, RANGES * parts)
    rows = _placed(keys, ruled(rules), at).repartition(parts, "range").sortWithinPartitions("range", "key")
    return rows.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_AZ = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
SQL = f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  rules(v, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
  hit AS (SELECT u.page_id, u.host, u.path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS nth FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
  SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE nth = 1"""
