"""The memory table: a log of Parquet files, an index of ids, and small state files that say what counts.

Layout: write number ``w`` adds ``log/write=<w>/user_bucket=<n>`` (rows) and ``ids/write=<w>/id_bucket=<n>`` (where each id of the write
now lives).  ``state/<n>.json`` names the writes that count, per bucket the first one that does, the folders still to be
deleted, and the schema's version; the last state counts.  A write is whole or not there: its files count once its state
is written, in one rename.  One writer at a time: of two, the second to write a state fails.

An id belongs to whoever wrote it last.  When a row comes in under another user, the write adds a note to the former
owner's bucket that the id has moved; so a user's rows are told from their own bucket alone.  The index tells a write
where its ids were, and ``get`` which bucket to read; both look at its buckets of the asked ids only, and Parquet's
statistics and bloom filters skip most of those.

Deletion is physical: the touched buckets (a moved id's former ones too) are written anew without the rows, the state that
makes them count names the old folders as garbage, and they are deleted.  What a crash leaves is deleted by the next write,
``compact`` or ``clean``: garbage that the state names, folders of writes that never counted, staged texts.  The index
holds ids and bucket numbers, no texts and no users.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrywell.operators.recall import candidates, in_states
from quarrywell.schema import RECORD, STATES, VERSION
from quarrywell.sources import folders, json_files

BUCKETS = 32
#: Ids of a write up to which they are handed to the index's scan as literals, and their files have no bloom filters; more are joined.
FEW = 1000
_NOTES = [T.StructField("version", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("moved", T.BooleanType()), T.StructField("held_in", T.ArrayType(T.IntegerType()))]
LOG = T.StructType([*RECORD.fields, *_NOTES, T.StructField("write", T.LongType()), T.StructField("user_bucket", T.IntegerType())])
IDS = T.StructType([
    T.StructField("memory_id", T.StringType()), T.StructField("lives_in", T.IntegerType()), T.StructField("owner", T.LongType()), T.StructField("held_in", T.ArrayType(T.IntegerType())), T.StructField("place", T.LongType()),
    T.StructField("write", T.LongType()), T.StructField("id_bucket", T.IntegerType()),
])
FIELDS = [f.name for f in RECORD.fields]


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def owner_of(user: Column) -> Column:
    return F.xxhash64(user)


def latest(log: DataFrame) -> DataFrame:
    """The last version of each memory_id; it keeps the place (seq) of the first.  Summed up inside tasks first, so an id may
    have any number of versions."""
    moved = F.coalesce("moved", F.lit(False)) if "moved" in log.columns else F.lit(False)
    last = F.max_by(F.struct(*log.columns), F.struct("version", ~moved)).alias("r")
    return log.groupBy("memory_id").agg(last, F.min("seq").alias("place")).select("r.*", "place").withColumn("seq", F.coalesce("place", "seq")).drop("place")


def upgrade_schema(df: DataFrame) -> DataFrame:
    """Rows of any version with the columns of this one; missing tags become empty."""
    rows = df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields if f.name not in df.columns))
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


class MemoryTable:
    """DataFrames in, DataFrames out; reads are lazy and pushed down, writes are Parquet commits.

    ``buckets``: of users and of ids, of a new table; a deletion rewrites its user's, so large tables want many."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), buckets

    # -- state

    def _state(self) -> tuple[int, dict]:
        """Number and content of the state that counts.  A table without one has all writes that are there."""
        names = [n for n in folders.names_in(self.spark, f"{self.path}/state") if n.endswith(".json")]
        if not names:
            return 0, {"writes": self._folders("log"), "since": {}, "ids_since": 0, "garbage": [], "version": None, "buckets": self._new_buckets, "indexed": not self._folders("log")}
        return int(names[-1].removesuffix(".json")), json.loads(folders.text_of(self.spark, f"{self.path}/state/{names[-1]}"))

    def _folders(self, what: str) -> list[int]:
        return sorted(int(n.removeprefix("write=")) for n in folders.names_in(self.spark, f"{self.path}/{what}") if re.fullmatch(r"write=\d+", n))

    def _commit(self, number: int, state: dict) -> None:
        folders.put(self.spark, f"{self.path}/state/{number + 1:012d}.json", [json.dumps(state).encode()])

    def clean(self) -> None:
        """Delete what no state needs: garbage of earlier writes, files of writes that never counted, staged rows."""
        number, state = self._state()
        for path in state["garbage"]:
            folders.remove(self.spark, f"{self.path}/{path}")
        for what in ("log", "ids"):
            for w in set(self._folders(what)) - set(state["writes"]):
                folders.remove(self.spark, f"{self.path}/{what}/write={w}")
        for name in folders.names_in(self.spark, f"{self.path}/staged"):
            if not name.startswith(f"{number:012d}-"):  # what belongs to a write that goes on has the number of the state it began with
                folders.remove(self.spark, f"{self.path}/staged/{name}")
        folders.remove_but_last(self.spark, f"{self.path}/state")
        if state["garbage"]:
            self._commit(number, state | {"garbage": []})
            folders.remove_but_last(self.spark, f"{self.path}/state")
        self.spark.catalog.refreshByPath(f"{self.path}/log")

    def staged(self, name: str) -> str:
        """A folder for rows of a write that is being made."""
        return f"{self.path}/staged/{self._state()[0]:012d}-{name}-{uuid.uuid4().hex}"

    def _stage(self, rows: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = self.staged(name)
        rows.write.parquet(path)
        return path, self.spark.read.schema(rows.schema).parquet(path)

    # -- reading

    def _read(self, what: str, schema: T.StructType, state: dict, since: Column) -> DataFrame:
        there = set(self._folders(what))
        paths = [f"{self.path}/{what}/write={w}" for w in state["writes"] if w in there]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths).where(F.col("write") >= since)

    def _log(self, state: dict | None = None) -> DataFrame:
        state = state or self._state()[1]
        since = [x for b, w in state["since"].items() for x in (F.lit(int(b)), F.lit(int(w)).cast("long"))]
        first = F.coalesce(F.create_map(*since)[F.col("user_bucket")], F.lit(0).cast("long")) if since else F.lit(0).cast("long")
        return upgrade_schema(self._read("log", LOG, state, first)).withColumns({"version": F.coalesce("version", "write"), "moved": F.coalesce("moved", F.lit(False))})

    @staticmethod
    def _own(user_id: str, buckets: int) -> Column:
        """Whether a row is in the user's bucket and was theirs at some time; rows of before there were owners by their user."""
        user, owner = F.lit(user_id), F.col("owner")
        return (F.col("user_bucket") == bucket_of(user, buckets)) & ((owner == owner_of(user)) | (owner.isNull() & (F.col("user_id") == user)))

    def _ids(self, state: dict) -> DataFrame:
        return self._read("ids", IDS, state, F.lit(state["ids_since"]).cast("long"))

    def get_all(self) -> DataFrame:
        return latest(self._log()).where("NOT moved").select(FIELDS)

    def get_all_by_user(self, user_id: str, states=None) -> DataFrame:
        """From the user's bucket alone.  Rows of ids that went to others meet the notes that say so."""
        _, state = self._state()
        own = self._log(state).where(self._own(user_id, state["buckets"]))
        return latest(own).where(~F.col("moved") & (F.col("user_id") == user_id) & in_states(states)).select(FIELDS)

    def of_users(self, users: DataFrame) -> DataFrame:
        """The rows of all states of the users in ``users`` (user_id), from their buckets alone."""
        _, state = self._state()
        asked = users.select("user_id", owner_of(F.col("user_id")).alias("owner")).where("user_id IS NOT NULL").distinct()
        touched = [r[0] for r in asked.select(bucket_of(F.col("user_id"), state["buckets"])).distinct().collect()]  # as many as there are buckets at most
        own = self._log(state).where(F.col("user_bucket").isin(touched)).withColumn("owner", F.coalesce("owner", owner_of(F.col("user_id")))).join(asked.select("owner").distinct(), "owner", "left_semi")
        return latest(own).where("NOT moved").join(asked.select("user_id"), "user_id", "left_semi").select(FIELDS)

    def _where(self, memory_id: str, state: dict):
        """What the index has of an id: lives_in (null if it was deleted), held_in; None if nothing."""
        there = self._ids(state).where((F.col("id_bucket") == bucket_of(F.lit(memory_id), state["buckets"])) & (F.col("memory_id") == memory_id))
        return there.groupBy("memory_id").agg(F.max_by(F.struct("lives_in", "held_in"), "write").alias("r")).select("r.*").first()

    def get(self, memory_id: str) -> DataFrame:
        """The index names the one bucket to read."""
        state = self._indexed()[1]
        at = self._where(memory_id, state)
        bucket = F.lit(False) if at is None or at["lives_in"] is None else F.col("user_bucket") == at["lives_in"]
        return latest(self._log(state).where(bucket & (F.col("memory_id") == memory_id))).where("NOT moved").select(FIELDS)

    def texts_of(self, user_id: str) -> DataFrame:
        """content of all that the user has, or had, while it is on disk."""
        _, state = self._state()
        return self._log(state).where(self._own(user_id, state["buckets"]) & (F.col("user_id") == user_id)).select("content")

    def texts_under(self, memory_id: str) -> DataFrame:
        """content of all versions of an id."""
        return self._log().where(F.col("memory_id") == memory_id).select("content")

    def get_by_tag(self, user_id: str, tag: str, states=None) -> DataFrame:
        if not tag.strip():
            raise ValueError("tag must not be blank")
        return self.get_all_by_user(user_id, states).where(F.array_contains("tags", tag))

    def search(self, user_id: str, embedding: list[float], top_k: int = 10, states=None) -> DataFrame:
        """The user's rows nearest to the vector, with ``sim``."""
        asked = self.spark.createDataFrame([(0, user_id, "", embedding)], "query_id long, user_id string, query string, embedding array<double>")
        return candidates(asked, self.get_all_by_user(user_id, list(STATES)), top_k, states).orderBy("pos").drop("query_id", "query", "q_emb", "pos")

    def get_all_users(self) -> DataFrame:
        return latest(self._log().select("memory_id", "user_id", "seq", "version", "moved")).where("NOT moved").select("user_id").distinct()

    def count(self, user_id: str) -> int:
        return self.get_all_by_user(user_id, list(STATES)).count()

    def next_seq(self) -> int:
        top = self._log().agg(F.max("seq")).first()[0]
        return 0 if top is None else top + 1

    def size(self) -> int:
        """Bytes on disk."""
        return folders.bytes_in(self.spark, self.path)

    def known_ids(self, ids: DataFrame | None = None) -> DataFrame:
        """memory_id of all rows, or of those among ``ids``, from the index."""
        state = self._indexed()[1]
        if ids is not None:
            return self._known(ids, state, self._few(ids, state)).select("memory_id")
        return self._ids(state).groupBy("memory_id").agg(F.max_by(F.struct("lives_in"), "write").alias("r")).where("r.lives_in IS NOT NULL").select("memory_id")

    # -- writing

    def _indexed(self) -> tuple[int, dict]:
        """The state, after an index has been made if the table comes from before there was one."""
        number, state = self._state()
        if not state["indexed"]:
            w = max([number, *state["writes"]]) + 1
            rows = latest(self._log(state).select("memory_id", "user_id", "seq", "version", "moved", "owner", "user_bucket")).where("NOT moved")
            self._put_ids(rows.select("memory_id", F.col("user_bucket").alias("lives_in"), F.coalesce("owner", owner_of(F.col("user_id"))).alias("owner"), F.array("user_bucket").alias("held_in"), F.col("seq").alias("place")), w, state)
            self._commit(number, state | {"writes": [*state["writes"], w], "indexed": True})
            number, state = self._state()
        return number, state

    def _put(self, rows: DataFrame, what: str, w: int, bucket: str, order: list[str], small: bool) -> None:
        # Buckets of about equal files, large ones in several; sorted, so that statistics tell files and row groups apart.
        spread = rows.hint("rebalance", bucket).sortWithinPartitions(bucket, *order)
        # As large as the ids of a file ask for; unless told so, each would take a megabyte.
        bloom = {} if small else {"parquet.bloom.filter.enabled#memory_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        spread.write.mode("append").options(**bloom).partitionBy(bucket).parquet(f"{self.path}/{what}/write={w}")

    def _put_log(self, rows: DataFrame, w: int, small: bool = False) -> None:
        self._put(rows.select([n for n in LOG.fieldNames() if n != "write"]), "log", w, "user_bucket", ["owner", "memory_id"], small)

    def _put_ids(self, rows: DataFrame, w: int, state: dict, small: bool = False) -> None:
        rows = rows.withColumn("id_bucket", bucket_of(F.col("memory_id"), state["buckets"]))
        self._put(rows.select([n for n in IDS.fieldNames() if n != "write"]), "ids", w, "id_bucket", ["memory_id"], small)

    def _few(self, ids: DataFrame, state: dict) -> list | None:
        """The ids with their buckets, if they are few."""
        some = ids.select("memory_id", bucket_of(F.col("memory_id"), state["buckets"]).alias("b")).limit(FEW + 1).collect()
        return some if len(some) <= FEW else None

    def _known(self, ids: DataFrame, state: dict, some: list | None) -> DataFrame:
        """memory_id and ``was`` (lives_in, owner, held_in, place) of those ids that are stored; ``some``: the ids, if they are few."""
        index = self._ids(state)
        if some is not None:
            index = index.where(F.col("id_bucket").isin(sorted({r["b"] for r in some})) & F.col("memory_id").isin([r["memory_id"] for r in some]))
        else:
            index = index.join(ids.select("memory_id"), "memory_id", "left_semi")
        return index.groupBy("memory_id").agg(F.max_by(F.struct("lives_in", "owner", "held_in", "place"), "write").alias("was")).where("was.lives_in IS NOT NULL")

    def _begin(self) -> tuple[int, dict, int]:
        """State number, state and the number of the write that begins, after cleaning up."""
        self.clean()
        number, state = self._indexed()
        return number, state, max([number, *state["writes"]]) + 1

    def store(self, rows: DataFrame) -> None:
        """Insert or replace by memory_id, whoever had the id; of several rows of one id the last by seq counts."""
        number, state, w = self._begin()
        rows = upgrade_schema(rows).select(FIELDS)
        rows = rows.groupBy("memory_id").agg(F.max_by(F.struct(*FIELDS), F.coalesce("seq", F.lit(-1))).alias("r"), F.min("seq").alias("first")).select("r.*", "first")
        path, rows = self._stage(rows, "rows")  # read four times; ids and vectors must be the same each time
        some = self._few(rows, state)
        known = self._known(rows, state, some)
        own, owner = bucket_of(F.col("user_id"), state["buckets"]), owner_of(F.col("user_id"))
        rows = rows.withColumns({"user_bucket": own, "owner": owner}).join(known, "memory_id", "left")
        rows = rows.withColumns({"seq": F.coalesce("was.place", "first"), "version": F.lit(w).cast("long"), "held_in": F.array_union(F.coalesce("was.held_in", F.array().cast("array<int>")), F.array("user_bucket"))})
        left = rows.where("was.owner <> owner").select(*(F.col("memory_id") if n == "memory_id" else F.col("was.lives_in").alias(n) if n == "user_bucket" else F.col("was.owner").alias(n) if n == "owner" else F.lit(True).alias(n) if n == "moved" else F.lit(w).cast("long").alias(n) if n == "version" else F.lit(None).cast(LOG[n].dataType).alias(n) for n in LOG.fieldNames() if n != "write"))
        self._put_log(rows.withColumn("moved", F.lit(False)).select([n for n in LOG.fieldNames() if n != "write"]).unionByName(left), w, some is not None)
        self._put_ids(rows.select("memory_id", F.col("user_bucket").alias("lives_in"), "owner", "held_in", F.col("seq").alias("place")), w, state, some is not None)
        self._commit(number, state | {"writes": [*state["writes"], w]})
        folders.remove(self.spark, path)

    update = store

    def _replace(self, number: int, state: dict, w: int, kept: DataFrame, touched: list[int], ids: DataFrame, whole: bool = False) -> None:
        """Take ``kept`` in place of all that the touched buckets hold, and add to the index, or replace it."""
        self._put_log(kept, w)
        self._put_ids(ids, w, state)
        if whole:
            after = {"writes": [w], "since": {}, "ids_since": w, "garbage": [f"{what}/write={o}" for o in state["writes"] for what in ("log", "ids")]}
        else:
            after = {"writes": [*state["writes"], w], "since": state["since"] | {str(b): w for b in touched}, "garbage": [f"log/write={o}/user_bucket={b}" for o in state["writes"] for b in touched]}
        self._commit(number, state | after)
        self.clean()

    def _erase(self, gone: DataFrame, touched: list[int], extra: Column, begun: tuple[int, dict, int]) -> None:
        """Write the touched buckets anew without the ids in ``gone`` and the rows that ``extra`` tells."""
        number, state, w = begun
        kept = self._log(state).where(F.col("user_bucket").isin(touched) & ~F.coalesce(extra, F.lit(False))).join(gone, "memory_id", "left_anti")
        nothing = gone.select("memory_id", *(F.lit(None).cast(IDS[n].dataType).alias(n) for n in ("lives_in", "owner", "held_in", "place")))
        self._replace(number, state, w, kept, touched, nothing)

    def delete_by_user(self, user_id: str) -> int:
        begun = number, state, _ = self._begin()
        user = F.lit(user_id)
        own = self._log(state).where(self._own(user_id, state["buckets"]))
        ids = latest(own.select("memory_id", "user_id", "seq", "version", "moved", "held_in", "user_bucket")).where(~F.col("moved") & (F.col("user_id") == user_id))
        path, ids = self._stage(ids.select("memory_id", F.array_union(F.coalesce("held_in", F.array().cast("array<int>")), F.array("user_bucket")).alias("held_in")), "erased-ids")
        n = ids.count()
        old = own.where(F.col("user_id") == user_id).limit(1).count()  # texts of ids that have moved on are the user's too
        if n or old:
            touched = {r[0] for r in ids.select(F.explode("held_in")).distinct().collect()} | {self.spark.range(1).select(bucket_of(user, state["buckets"])).first()[0]}  # as many as there are buckets at most
            self._erase(ids.select("memory_id"), sorted(touched), F.col("user_id") == user_id, begun)
        folders.remove(self.spark, path)
        return n

    def delete_by_id(self, memory_id: str) -> bool:
        begun = number, state, _ = self._begin()
        at = self._where(memory_id, state)
        if at is None or at["lives_in"] is None:
            return False
        gone = self.spark.createDataFrame([(memory_id,)], "memory_id string")
        self._erase(gone, sorted({at["lives_in"], *(at["held_in"] or [])}), F.lit(False), begun)
        return True

    def compact(self) -> None:
        """Keep the last version of each row only; nothing else stays on disk."""
        number, state, w = self._begin()
        rows = latest(self._log(state)).where("NOT moved").withColumns({"held_in": F.array("user_bucket"), "owner": owner_of(F.col("user_id"))})
        self._replace(number, state, w, rows.select([n for n in LOG.fieldNames() if n != "write"]), [], rows.select("memory_id", F.col("user_bucket").alias("lives_in"), "owner", "held_in", F.col("seq").alias("place")), whole=True)

    def schema_version(self) -> int:
        """As recorded; a table without a record has the current one."""
        return self._state()[1].get("version") or VERSION

    def upgrade_schema(self, from_version: int, to_version: int) -> None:
        """Record the version; rows of older files are read with the columns of this one (see ``upgrade_schema`` above)."""
        if to_version < from_version:
            raise ValueError("versions only go up")
        number, state = self._indexed()
        self._commit(number, state | {"version": to_version})

    def upgrade(self) -> int:
        now = self.schema_version()
        if self._state()[1].get("version") != VERSION:
            self.upgrade_schema(now, VERSION)
        return VERSION

    # -- JSON

    def export(self, path: str) -> int:
        """JSON lines, a file for each partition; the number of rows."""
        return json_files.write_lines(self.get_all(), path)

    def export_array(self, path: str) -> int:
        """One file with one JSON array, in store order; the number of rows."""
        return json_files.write_array(self.get_all(), path)

    def import_from(self, path: str, now=None) -> int:
        """Rows of a JSON array or JSON lines whose ids are neither stored nor earlier in the file."""
        rows = json_files.imported(self.spark, path, now)
        fresh = rows.join(self.known_ids(), "memory_id", "left_anti").withColumn("seq", F.col("seq") + F.lit(self.next_seq()))
        held, fresh = self._stage(fresh, "import")
        n = fresh.count()
        if n:
            self.store(fresh)
        folders.remove(self.spark, held)
        return n

