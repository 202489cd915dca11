"""A PySpark-native memory and corpus engine."""

from quarrywell.schema import RECORD, SOURCES, STATES, Config, LifecycleState, MemoryObject, MemorySource

__all__ = ["RECORD", "SOURCES", "STATES", "ChatMemory", "Config", "FunctionEmbedder", "HashEmbedder", "LifecycleState", "Memory", "MemoryObject", "MemorySource", "MemoryTable", "VectorCache"]
_PLACES = {"Memory": "engine", "ChatMemory": "engine", "MemoryTable": "sources.table", "VectorCache": "sources.vectors", "HashEmbedder": "embedding", "FunctionEmbedder": "embedding"}


def __getattr__(name: str):
    """The rest is imported when it is first asked for: workers import this package too."""
    if name not in _PLACES:
        raise AttributeError(f"no {name} in {__name__}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
