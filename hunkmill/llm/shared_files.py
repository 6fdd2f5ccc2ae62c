"""Files that tasks write and read in the folder the cluster shares, by its URI.

``pyarrow.fs`` opens local mounts and object stores alike. A file gets a name of its own per task
attempt and is listed only in rows the task returns, so lost or repeated attempts leave at most
unlisted files behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def new_file(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/part-{partition_id():06d}-{uuid.uuid4().hex}{suffix}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def writing(path: str):
    system, name = _open(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def reading(path: str):
    system, name = _open(path)
    return system.open_input_file(name)


def with_scheme(path: str) -> str:
    """``file:///a`` for ``file:/a`` and ``/a``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else f"file://{path}"
