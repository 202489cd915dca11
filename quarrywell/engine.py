"""The facade: remember, recall, forget and what belongs to them, for one user at a time or for many.

Reads are lazy DataFrames; the write that a recall entails is ``touch``, a call of its own.
"""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywell.embedding import HashEmbedder
from quarrywell.functions import scoring, text
from quarrywell.operators import checks, dedup, lifecycle, recall, stats
from quarrywell.operators.recall import PREFIX
from quarrywell.schema import ACTIVE, RECORD, STATES, USER_STATED, Config
from quarrywell.sources import folders
from quarrywell.sources.stores import next_seq
from quarrywell.sources.table import MemoryTable
from quarrywell.sources.vectors import VectorCache


def _given(**values: str) -> None:
    for name, value in values.items():
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must not be blank")


class Memory:
    """Keeps its rows in a ``MemoryTable`` under ``path``, or in any other ``store``.  ``now`` (a function) gives the time of
    writes and scores.  ``vectors``: a path under which the vectors of texts are kept, so that an embedder is asked for a text once."""

    def __init__(self, spark: SparkSession, path: str | None = None, embed=None, config: Config | None = None, now=None, store=None, vectors: str | None = None):
        if path is None and store is None:
            raise ValueError("a path or a store is needed")
        self.spark, self.path, self.table = spark, path, store or MemoryTable(spark, path)
        self.embed, self.config = embed or HashEmbedder(), config or Config()
        self.now, self.vectors = now or (lambda: datetime.now(timezone.utc)), vectors

    def _held(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows as files of the table, so that ids and vectors are made once; what a failure leaves goes with the next write."""
        staged = getattr(self.table, "staged", None)
        path = staged(name) if staged else folders.shared_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _embedded(self, rows: DataFrame, embed, batch_size: int | None = None) -> DataFrame:
        """rows with the vectors of their contents."""
        if self.vectors:
            rows = VectorCache(self.spark, self.vectors, embed.name()).embedded(rows, embed, batch_size=batch_size)
        else:
            rows = rows.withColumn("embedding", embed.column(F.col("content"), batch_size))
        return rows.withColumn("embedding_dim", F.lit(embed.dimension()))

    def _stamp(self) -> F.Column:
        return F.lit(self.now().astimezone(timezone.utc).isoformat()).cast("timestamp")

    # -- writing

    def _rows(self, user_id: str, contents: Iterable[str], importance: float, source: str, metadata: dict | None, sanitize: bool, tags) -> DataFrame:
        import json

        if isinstance(importance, bool) or not isinstance(importance, (int, float)):
            raise TypeError("importance must be a number")
        seq = next_seq(self.table)
        plain = self.spark.createDataFrame([(str(uuid.uuid4()), user_id, c, seq + k) for k, c in enumerate(contents)], "memory_id string, user_id string, content string, seq long")
        plain = plain.withColumn("content", text.sanitize("content", strict=self.config.sanitize)) if sanitize else plain
        made = plain.withColumns({
            "embedding": self.embed.column(F.col("content")), "embedding_dim": F.lit(self.embed.dimension()), "created_at": self._stamp(), "last_accessed_at": self._stamp(), "source": F.lit(source),
            "importance": F.lit(max(0.0, min(1.0, float(importance)))), "lifecycle_state": F.lit(ACTIVE), "metadata": F.lit(json.dumps(metadata or {})), "tags": F.array(*map(F.lit, tags or [])).cast("array<string>"),
        })
        return self._held(made.select([F.col(f.name).cast(f.dataType) for f in RECORD.fields]), "new")

    def remember(self, user_id: str, content: str, importance: float | None = None, source: str = USER_STATED, metadata: dict | None = None, sanitize_input: bool = False, tags=None) -> str:
        return self.remember_many(user_id, [content], importance, source, metadata, sanitize_input, tags)[0]

    def remember_many(self, user_id: str, contents: list[str], importance: float | None = None, source: str = USER_STATED, metadata: dict | None = None, sanitize_input: bool = False, tags=None) -> list[str]:
        """The id that holds each content: a new one, or that of the row it was merged into."""
        _given(user_id=user_id, **{f"content {k}": c for k, c in enumerate(contents)})
        if not contents:
            return []
        rows = self._rows(user_id, contents, self.config.default_importance if importance is None else importance, source, metadata, sanitize_input, tags)
        scratch: list[str] = []
        out = self._held(dedup.folded(rows, self.table.get_all_by_user(user_id, list(STATES)), self.now().astimezone(timezone.utc).replace(tzinfo=None), self.config.dedup_threshold, self.config.conflict_threshold, scratch=scratch), "folded")
        self.table.store(out.drop("sources"))
        holder = {r["new"]: r["memory_id"] for r in out.select(F.explode("sources").alias("new"), "memory_id").collect()}  # ids of this batch
        ids = [holder[r["memory_id"]] for r in rows.select("memory_id", "seq").orderBy("seq").collect()]
        for path in [*scratch, *(f.rsplit("/", 1)[0] for done in (rows, out) for f in done.inputFiles())]:
            folders.remove(self.spark, path)
        return ids

    def remember_rows(self, rows: DataFrame, sanitize_input: bool = False) -> DataFrame:
        """Remember a whole DataFrame: user_id, content, and where they are there row (a name for each; else its place), importance, source,
        metadata (JSON) and tags.  Rows that ``checks.problem`` finds fault with fail the write, before anything is stored.
        Gives row and memory_id, the id that now holds it."""
        last = next_seq(self.table)
        have = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
        content = text.sanitize("content", strict=self.config.sanitize) if sanitize_input else F.col("content")
        place = (F.col("qw_place") + last).cast("long")
        told = rows.withColumns({"qw_place": F.monotonically_increasing_id(), "qw_wrong": checks.problem(rows.columns)})
        made = told.select(
            (F.col("row") if "row" in rows.columns else F.col("qw_place")).cast("string").alias("row"), F.uuid().alias("memory_id"), checks.fail_where("user_id", "qw_wrong").alias("user_id"), content.alias("content"),
            self._stamp().alias("created_at"), self._stamp().alias("last_accessed_at"), have("source", F.lit(USER_STATED)).alias("source"), scoring.clamp(have("importance", F.lit(self.config.default_importance))).alias("importance"), F.lit(ACTIVE).alias("lifecycle_state"),
            have("metadata", F.lit("{}")).alias("metadata"), have("tags", F.array().cast("array<string>")).alias("tags"), place.alias("seq"),
        )
        named = self._held(made, "named")  # ids are given once
        held = self._held(self._embedded(named, self.embed).select("row", *(F.col(f.name).cast(f.dataType) for f in RECORD.fields)), "new")
        scratch: list[str] = []
        known = self._rows_of(held.select("user_id"))
        out = self._held(dedup.folded(held.drop("row"), known, self.now().astimezone(timezone.utc).replace(tzinfo=None), self.config.dedup_threshold, self.config.conflict_threshold, scratch=scratch), "folded")
        path = folders.shared_path(self.spark, "remembered")
        out.select("memory_id", F.explode("sources").alias("source")).join(held.select("row", F.col("memory_id").alias("source")), "source").select("row", "memory_id").write.parquet(path)
        self.table.store(out.drop("sources"))
        for p in [*scratch, *(f.rsplit("/", 1)[0] for done in (named, held, out) for f in done.inputFiles())]:
            folders.remove(self.spark, p)
        return self.spark.read.schema("row string, memory_id string").parquet(path)

    def update(self, memory_id: str, content: str | None = None, importance: float | None = None, user_id: str | None = None, strict_owner: bool = False) -> str:
        """``strict_owner``: only a row of ``user_id`` is changed."""
        if content is None and importance is None:
            return memory_id
        rows = self.table.get(memory_id)
        if strict_owner:
            _given(user_id=user_id)
            rows = rows.where(F.col("user_id") == user_id)
        if rows.isEmpty():
            raise ValueError(f"no memory {memory_id}")
        if content is not None:
            rows = rows.withColumn("content", F.lit(content)).withColumn("embedding", self.embed.column(F.col("content"))).withColumn("embedding_dim", F.lit(self.embed.dimension()))
        if importance is not None:
            rows = rows.withColumn("importance", F.lit(max(0.0, min(1.0, float(importance)))))
        self.table.update(rows.select([f.name for f in RECORD.fields]))
        return memory_id

    def forget(self, user_id: str, memory_id: str | None = None, strict_owner: bool = False) -> int:
        _given(user_id=user_id)
        if memory_id is None:
            self._forget_vectors(lambda: self.table.texts_of(user_id))
            return self.table.delete_by_user(user_id)
        if strict_owner and self.table.get(memory_id).where(F.col("user_id") == user_id).isEmpty():
            return 0
        self._forget_vectors(lambda: self.table.texts_under(memory_id))
        return int(self.table.delete_by_id(memory_id))

    def _forget_vectors(self, texts) -> None:
        """Before the rows go, so that a failure can be repeated; those of all models."""
        if self.vectors:
            for name in folders.names_in(self.spark, self.vectors):
                VectorCache.at(self.spark, f"{self.vectors.rstrip('/')}/{name}").erase(texts())

    def migrate(self, user_id: str, embed, batch_size: int = 100) -> int:
        """Embed the user's active and decaying rows anew, ``batch_size`` texts in a call of the embedder."""
        _given(user_id=user_id)
        if batch_size < 1:
            raise ValueError("batch_size must be 1 or more")
        rows = self._held(self._embedded(self.table.get_all_by_user(user_id), embed, batch_size).select([f.name for f in RECORD.fields]), "migrated")
        n = rows.count()
        if n:
            self.table.update(rows)
        return n

    def touch(self, recalled: DataFrame, persist_access: bool = False) -> None:
        rows = recalled.select([f.name for f in RECORD.fields])
        self.table.store(lifecycle.touch(rows, self._stamp(), self.config.decay_threshold_hours, persist_access))

    # -- reading

    def recall_many(self, queries: DataFrame, top_k: int | None = None, max_tokens: int | None = None, lifecycle_filter=None, hybrid_search: bool | None = None, token_counter=None) -> DataFrame:
        """``queries``: query_id, user_id, query; embedded here.  ``token_counter``: a function from a text to its tokens' number."""
        asked = queries.withColumn("embedding", self.embed.column(F.col("query")))
        limit = self.config.max_tokens_default if max_tokens is None else max_tokens
        hybrid = self.config.hybrid_search if hybrid_search is None else hybrid_search
        return recall.recall_many(asked, self._rows_of(queries), self._stamp(), self.config.default_top_k if top_k is None else top_k, limit, lifecycle_filter, hybrid, self.config.decay_half_life_hours, token_counter, self.embed.dimension())

    def _rows_of(self, queries: DataFrame) -> DataFrame:
        """The rows of the users that ask, where the store can tell them apart without reading all."""
        return self.table.of_users(queries) if hasattr(self.table, "of_users") else self.table.get_all()

    def recall(self, user_id: str, query: str, top_k: int | None = None, **kwargs) -> DataFrame:
        _given(user_id=user_id, query=query)
        if top_k is not None and top_k < 1:
            raise ValueError("top_k must be 1 or more")
        return self.recall_many(self.spark.createDataFrame([(0, user_id, query)], "query_id long, user_id string, query string"), top_k, **kwargs).orderBy("rank")

    def recall_since(self, user_id: str, query: str, hours: float = 24, top_k: int | None = None, max_tokens: int | None = None, lifecycle_filter=None) -> DataFrame:
        """The token budget is spent on what is recalled before the time is looked at."""
        _given(user_id=user_id, query=query)
        asked = self.spark.createDataFrame([(0, user_id, query)], "query_id long, user_id string, query string").withColumn("embedding", self.embed.column(F.col("query")))
        limit = self.config.max_tokens_default if max_tokens is None else max_tokens
        return recall.recall_since(asked, self._rows_of(asked), self._stamp(), hours, self.config.default_top_k if top_k is None else top_k, max_tokens=limit, states=lifecycle_filter, hybrid=self.config.hybrid_search, half_life=self.config.decay_half_life_hours, dimension=self.embed.dimension()).orderBy("rank")

    def recall_by_tag(self, user_id: str, tag: str, lifecycle_filter=None) -> DataFrame:
        _given(user_id=user_id, tag=tag)
        return self.table.get_by_tag(user_id, tag, lifecycle_filter)

    def context_block(self, user_id: str, query: str, top_k: int | None = None, max_tokens: int = 1500, prefix: str = PREFIX) -> str:
        found = recall.context_blocks(self.recall(user_id, query, top_k, max_tokens=max_tokens), prefix).first()
        return found["block"] if found else ""

    def list_users(self) -> list[str]:
        return sorted(r[0] for r in self.table.get_all_users().collect())

    def stats(self, user_id: str, states=None) -> dict:
        _given(user_id=user_id)
        rows = self.table.get_all_by_user(user_id, states)
        out = stats.stats(rows, by_user=False, states=states).first().asDict()
        named = lambda head: {k.removeprefix(head): n for k, n in out.items() if k.startswith(head)}
        return {
            "total": out["total"], "by_lifecycle": named("state_"), "by_source": named("source_"), "avg_importance": out["avg_importance"],
            "tag_counts": {r["tag"]: r["n"] for r in stats.tag_counts(rows, states).collect()}, "total_with_tags": out["with_tags"], "total_without_tags": out["without_tags"],
        }

    def export(self, path: str) -> int:
        """A path that ends with .json gets one file with one array, any other a folder of JSON lines."""
        return self.table.export_array(path) if path.endswith(".json") else self.table.export(path)

    def import_from(self, path: str) -> int:
        return self.table.import_from(path, self.now().astimezone(timezone.utc).isoformat())

    def upgrade(self) -> int:
        return self.table.upgrade()

    def save_context(self, user_id: str, inputs: dict, outputs: dict | None = None, query_key: str = "input") -> None:
        """Chat memory: what the person said is remembered, what was answered is not."""
        said = str(inputs.get(query_key) or "")
        if said.strip():
            self.remember(user_id, said)

    def load_memory_variables(self, user_id: str, inputs: dict, query_key: str = "input") -> dict[str, str]:
        asked = str(inputs.get(query_key) or "")
        return {"history": self.context_block(user_id, asked) if asked.strip() else ""}


class ChatMemory:
    """One person's chat memory."""

    memory_variables = ("history",)

    def __init__(self, user_id: str, memory: Memory, query_key: str = "input", output_key: str = "output"):
        self.user_id, self.memory, self.query_key, self.output_key = user_id, memory, query_key, output_key

    def save_context(self, inputs: dict, outputs: dict | None = None) -> None:
        self.memory.save_context(self.user_id, inputs, outputs, self.query_key)

    def load_memory_variables(self, inputs: dict) -> dict[str, str]:
        return self.memory.load_memory_variables(self.user_id, inputs, self.query_key)

    def clear(self) -> None:
        self.memory.forget(self.user_id)


def _in_thread(name: str):
    async def run(self, *args, **kwargs):
        return await asyncio.to_thread(getattr(self, name), *args, **kwargs)

    run.__name__ = f"a{name}"
    return run


for _name in ("remember", "recall", "forget", "context_block", "export", "import_from", "stats", "recall_by_tag", "list_users", "update", "recall_since", "remember_many"):
    setattr(Memory, f"a{_name}", _in_thread(_name))
