"""What a store of memories offers, and a store made of functions.  DataFrames of the record go in and come out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywell.operators.recall import in_states


@runtime_checkable
class Store(Protocol):
    def store(self, rows: DataFrame) -> None: ...

    def update(self, rows: DataFrame) -> None: ...

    def search(self, user_id: str, embedding: list[float], top_k: int = 10, states=None) -> DataFrame: ...

    def get(self, memory_id: str) -> DataFrame: ...

    def get_by_tag(self, user_id: str, tag: str, states=None) -> DataFrame: ...

    def get_all(self) -> DataFrame: ...

    def get_all_by_user(self, user_id: str, states=None) -> DataFrame: ...

    def get_all_users(self) -> DataFrame: ...

    def count(self, user_id: str) -> int: ...

    def delete_by_user(self, user_id: str) -> int: ...

    def delete_by_id(self, memory_id: str) -> bool: ...

    def upgrade_schema(self, from_version: int, to_version: int) -> None: ...


def next_seq(store: Store) -> int:
    """The place of the next row in store order."""
    own = getattr(store, "next_seq", None)
    if own is not None:
        return own()
    top = store.get_all().agg(F.max("seq")).first()[0]
    return 0 if top is None else top + 1


#: The functions that a store can be made of.
CALLBACKS = ("store", "search", "get", "update", "delete_by_user", "delete_by_id", "get_all_by_user", "get_all", "count", "upgrade_schema", "get_all_users", "get_by_tag")


class CallbackStore:
    """A store that hands every call to a function given for it, as ``store_fn`` and so on.  A function that is missing
    raises when it is called; users and tags are found through ``get_all`` where they have none of their own."""

    def __init__(self, **functions: Callable):
        unknown = set(functions) - {f"{n}_fn" for n in CALLBACKS}
        if unknown:
            raise TypeError(f"no such functions: {sorted(unknown)}")
        self.functions = {k.removesuffix("_fn"): f for k, f in functions.items() if f is not None}

    def _call(self, name: str, *args):
        if name not in self.functions:
            raise NotImplementedError(f"{name}_fn was not given to this store")
        return self.functions[name](*args)

    def get_all_users(self) -> DataFrame:
        if "get_all_users" in self.functions:
            return self._call("get_all_users")
        return self._call("get_all").select("user_id").distinct()

    def get_by_tag(self, user_id: str, tag: str, states=None) -> DataFrame:
        if "get_by_tag" in self.functions:
            return self._call("get_by_tag", user_id, tag, states)
        return self._call("get_all").where((F.col("user_id") == user_id) & F.array_contains("tags", tag) & in_states(states))

    def search(self, user_id: str, embedding: list[float], top_k: int = 10, states=None) -> DataFrame:
        return self._call("search", user_id, embedding, top_k, states)

    def get_all_by_user(self, user_id: str, states=None) -> DataFrame:
        return self._call("get_all_by_user", user_id, states)


def _handed(name: str):
    def run(self, *args):
        return self._call(name, *args)

    run.__name__ = name
    return run


for _name in CALLBACKS:
    if not hasattr(CallbackStore, _name):
        setattr(CallbackStore, _name, _handed(_name))
