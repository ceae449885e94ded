"""Folder operations on any file system the cluster knows, through Hadoop's own client."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_folder: bool
    modified_ms: int


def _open(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _open(spark, path)
    return system.exists(where)


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """Direct children of a folder by name; empty if it does not exist."""
    system, where = _open(spark, path)
    if not system.exists(where):
        return []
    found = [
        Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime())
        for s in system.listStatus(where)
    ]
    return sorted(found, key=lambda e: e.name)


def delete_folder(spark: SparkSession, path: str) -> bool:
    system, where = _open(spark, path)
    return system.delete(where, True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, or return False if there is one already; two callers never both succeed.

    The content goes to a file of its own first. Hadoop's file systems do not replace a file by a rename; the local
    one does, so there the file gets its name by a hard link.
    """
    system, where = _open(spark, path)
    draft, name = _open(spark, f"{where.getParent().toString()}/_draft-{uuid.uuid4().hex}")
    stream = draft.create(name, False)
    stream.write(text.encode("utf-8"))
    stream.close()
    if system.getScheme() != "file":
        made = not system.exists(where) and system.rename(name, where)
    else:
        try:
            os.link(name.toUri().getPath(), where.toUri().getPath())
            made = True
        except FileExistsError:
            made = False
    draft.delete(name, False)
    return made


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _open(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
