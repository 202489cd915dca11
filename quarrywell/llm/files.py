"""Whole writes and range reads of files in the shared folder, from executors and driver alike.

``file:`` paths (a mounted shared folder) go through the operating system, any other scheme through pyarrow's file
systems (HDFS, S3, GCS).
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


def put(path: str, parts: list[bytes]) -> int:
    """Write a file whole: readers see all of it or nothing."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_output_stream(inner) as f:
            for p in parts:
                f.write(p)
    else:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        temp = f"{local}.{uuid.uuid4().hex}.part"
        with open(temp, "wb") as f:
            f.writelines(parts)
        os.replace(temp, local)
    return sum(map(len, parts))


class RangeFile:
    """Reads of ranges, without reading the rest."""

    def __init__(self, path: str):
        local = _local(path)
        if local is None:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self.size = store.get_file_info(inner).size
            self.file = store.open_input_file(inner)
        else:
            self.size = os.path.getsize(local)
            self.file = open(local, "rb")  # noqa: SIM115

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError(f"range {at}+{size} is outside of the file of {self.size} bytes")
        self.file.seek(at)
        got = self.file.read(size)
        if len(got) != size:
            raise ValueError(f"short read at {at}")
        return got

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
