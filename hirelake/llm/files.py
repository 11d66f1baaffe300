"""Binary files in the shared folder, written and read inside tasks.

A task names its file anew on every attempt. Which files count is told by the rows its attempt returns,
which Spark commits once: files of lost or doubled attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name below ``folder`` that no other attempt has; makes the folder."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/part-{partition():06d}-{uuid.uuid4().hex}{suffix}"


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def output(uri: str):
    system, path = opened(uri)
    return system.open_output_stream(path, compression=None)


def source(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
