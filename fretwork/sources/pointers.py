"""Numbered pointers: which of several written folders readers shall see.

A pointer is an empty file whose name says everything, so none is ever seen half written, and a folder shows up in one step. The
highest number counts; of two that were made at the same moment with one number, the name that comes last.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def files_of(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What stands in a folder, without hidden and temporary names; nothing where there is no folder."""
    at, files = files_of(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n for n in names if not n.startswith(("_", ".")))


def pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of all pointers, the current one last."""
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names_in(spark, folder))


def point_to(spark: SparkSession, folder: str, name: str) -> int:
    """Make ``name`` the current one; returns its number."""
    at, files = files_of(spark, folder)
    files.mkdirs(at)
    taken = pointers(spark, folder)
    number = taken[-1][0] + 1 if taken else 1
    pointer, _ = files_of(spark, f"{folder}/{number:08d}-{name}")
    if not files.createNewFile(pointer):
        raise FileExistsError(str(pointer))
    return number


def remove(spark: SparkSession, path: str) -> None:
    at, files = files_of(spark, path)
    files.delete(at, True)
