"""Shared folders, as files of the executors' Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenderspark.sources.shared import new_path, shared_dir, written

__all__ = ["file_system", "new_path", "shared_dir", "unused", "written"]


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores before it until no column of `df` is called that, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def file_system(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
