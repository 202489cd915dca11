"""The record of the memory table, its enumerations and the configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum

from pyspark.sql import types as T

# States, sources, the version of the record, its fields, and the defaults of the configuration.
ACTIVE, DECAYING, ARCHIVED, DELETED = STATES = ("active", "decaying", "archived", "deleted")
USER_STATED, AGENT_INFERRED, SYSTEM_GENERATED = SOURCES = ("user_stated", "agent_inferred", "system_generated")
RECALLED = (ACTIVE, DECAYING)
VERSION = 2

RECORD = T.StructType([
    T.StructField("memory_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_accessed_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("importance", T.DoubleType()),
    T.StructField("lifecycle_state", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("seq", T.LongType()),
])


class LifecycleState(StrEnum):
    ACTIVE, DECAYING, ARCHIVED, DELETED = STATES


class MemorySource(StrEnum):
    USER_STATED, AGENT_INFERRED, SYSTEM_GENERATED = SOURCES


@dataclass
class MemoryObject:
    """One row of the memory table for code that wants an object; ``of`` takes a row of any read, ``row`` gives one to store."""

    memory_id: str
    user_id: str
    content: str
    embedding: list[float] | None = None
    score: float = 0.0
    created_at: datetime | None = None
    last_accessed_at: datetime | None = None
    source: MemorySource = MemorySource.USER_STATED
    importance: float = 0.5
    lifecycle_state: LifecycleState = LifecycleState.ACTIVE
    metadata: dict = field(default_factory=dict)
    embedding_dim: int | None = None
    tags: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, row) -> MemoryObject:
        have = row.asDict()
        values = {n: have[n] for n in cls.__dataclass_fields__ if have.get(n) is not None}
        kinds = {"source": MemorySource, "lifecycle_state": LifecycleState, "metadata": json.loads}
        return cls(**{n: kinds[n](v) if n in kinds else v for n, v in values.items()})

    def row(self, seq: int | None = None) -> tuple:
        values = {n: getattr(self, n) for n in self.__dataclass_fields__} | {"source": str(self.source), "lifecycle_state": str(self.lifecycle_state), "metadata": json.dumps(self.metadata), "seq": seq}
        return tuple(values[f.name] for f in RECORD.fields)


@dataclass(frozen=True)
class Config:
    """Thresholds and defaults; refused if out of range."""

    dedup_threshold: float = 0.85
    conflict_threshold: float = 0.65
    decay_half_life_hours: float = 168.0
    decay_threshold_hours: float = 720.0
    default_importance: float = 0.5
    sanitize: bool = False
    default_top_k: int = 5
    max_tokens_default: int | None = None
    hybrid_search: bool = True

    def __post_init__(self):
        for name in ("dedup_threshold", "conflict_threshold", "default_importance"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("decay_half_life_hours", "decay_threshold_hours"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if self.default_top_k < 1 or (self.max_tokens_default is not None and self.max_tokens_default < 1):
            raise ValueError("default_top_k and max_tokens_default must be 1 or more")
