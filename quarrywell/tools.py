"""The tools that an agent's tool server offers, and their dispatch; the transport is the server's."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from quarrywell.embedding import fast_embedder
from quarrywell.engine import Memory


def _schema(required: str, **optional: str) -> dict:
    names = {n: "string" for n in required.split()} | optional
    return {"type": "object", "properties": {n: {"type": t} for n, t in names.items()}, "required": required.split()}


#: Names and arguments of the tools.
TOOLS = {
    "remember": ("Keep a memory of a user; one that says the same is rewritten.", _schema("user_id content", importance="number")),
    "recall": ("The user's memories nearest to a query.", _schema("user_id query", top_k="integer")),
    "forget": ("Delete one or all memories of a user, physically.", _schema("user_id", memory_id="string")),
    "context_block": ("Memories as text for a prompt.", _schema("user_id query", top_k="integer", max_tokens="integer")),
}


def settings() -> dict:
    """What a tool server is told by its environment: QUARRYWELL_PATH, QUARRYWELL_MODEL, QUARRYWELL_TOP_K."""
    env = os.environ.get
    return {"path": env("QUARRYWELL_PATH", os.path.expanduser("~/.quarrywell/memories")), "model": env("QUARRYWELL_MODEL", "BAAI/bge-small-en-v1.5"), "top_k": int(env("QUARRYWELL_TOP_K", "5"))}


def memory_of(spark: SparkSession, told: dict | None = None) -> Memory:
    """The memory that the environment names."""
    told = told or settings()
    return Memory(spark, told["path"], fast_embedder(told["model"]))


def call_tool(memory: Memory, name: str, arguments: dict) -> str:
    """The text that answers a call.  A missing argument raises KeyError; an unknown tool is said so.  Fixed values: the texts."""
    if name not in TOOLS:
        return f"Unknown tool: {name}"
    given = {k: arguments[k] for k in TOOLS[name][1]["required"]} | {k: v for k, v in arguments.items() if k in TOOLS[name][1]["properties"] and v is not None}
    if name == "remember":
        return f"Stored memory: {memory.remember(**given)}"
    if name == "forget":
        return f"Deleted {memory.forget(**given)} memory(ies)"
    if name == "context_block":
        return memory.context_block(**{"top_k": settings()["top_k"], "max_tokens": 1500} | given) or "No context found"
    found = [r["content"] for r in memory.recall(**{"top_k": settings()["top_k"]} | given).select("rank", "content").orderBy("rank").collect()]  # top_k rows
    return "\n".join(f"- {c}" for c in found) or "No memories found"
