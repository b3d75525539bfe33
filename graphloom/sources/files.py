"""Small files by Hadoop's file systems, so that a path may be local or on any store that Spark reads."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def base(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read(spark: SparkSession, path: str) -> bytes:
    """A file that fits the driver."""
    with fetched(spark, path) as local, open(local, "rb") as f:
        return f.read()


class fetched:
    """A local copy of a file, while it is needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs, self.path = _at(spark, path)
        self.jvm = spark.sparkContext._jvm

    def __enter__(self) -> str:
        self.folder = tempfile.mkdtemp(prefix="graphloom-")
        local = os.path.join(self.folder, "file")
        self.fs.copyToLocalFile(False, self.path, self.jvm.org.apache.hadoop.fs.Path("file://" + local), True)
        return local

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Replaces a file."""
    folder = tempfile.mkdtemp(prefix="graphloom-")
    try:
        local = os.path.join(folder, "file")
        with open(local, "wb") as f:
            f.write(data)
        fs, p = _at(spark, path)
        fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path("file://" + local), p)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def move_in(spark: SparkSession, local: str, path: str) -> None:
    """A local file to its place; replaces a file."""
    fs, p = _at(spark, path)
    fs.copyFromLocalFile(True, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path("file://" + local), p)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def on_executors(spark: SparkSession, folder: str):
    """A function that gives a folder's local path in a task: as it is where it is a local (or mounted) one, else of a copy
    that each executor fetches. Spark keeps copies by name: folders to be copied must differ in it in one session."""
    fs, p = _at(spark, folder)
    if fs.getUri().getScheme() == "file":
        local = p.toUri().getPath()
        return lambda: local
    spark.sparkContext.addFile(folder, recursive=True)
    name = base(folder)

    def fetched_to() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return fetched_to


def remove(spark: SparkSession, path: str) -> None:
    """A folder and what is in it."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
