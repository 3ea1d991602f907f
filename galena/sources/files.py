"""Files on any shared store, reached from tasks as from the driver."""

from __future__ import annotations

import re
from uuid import uuid4

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file whole or not at all: a reader never sees a part of it."""
    staged = f"{path}.{uuid4().hex}.part"
    with store.open_output_stream(staged) as out:
        out.write(data)
    store.move(staged, path)
