"""Binary files that tasks write to, and read from, any store that pyarrow can reach.

A task writes under a name that holds its attempt, and reports that name in the
row it returns. Only rows of successful attempts reach the manifest, so a file of
a lost or repeated attempt is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of ``uri`` and the path in it; plain paths are local."""
    if uri.startswith("file:") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def fresh_name(stem: str, suffix: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    part = f"{task.partitionId():06d}-{task.attemptNumber()}" if task else "000000-0"
    return f"{stem}-{part}-{uuid.uuid4().hex[:12]}{suffix}"


def create(folder: str, name: str):
    """An output stream for ``folder/name``; the folder is made if need be."""
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    return files.open_output_stream(f"{path}/{name}", compression=None)


def open_at(folder: str, name: str):
    """A seekable input file."""
    files, path = store(folder)
    return files.open_input_file(f"{path}/{name}")
