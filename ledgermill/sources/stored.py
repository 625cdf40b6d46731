"""Folders that jobs write step by step: which ones are complete, scratch folders that go when they are done with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..operators.identity import ensure_checkpoint_dir


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders `name=n` under path whose write has ended, in order."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{name}=")]
    done = [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in done)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def mark(spark: SparkSession, path: str) -> None:
    """Say that what stands in the folder is complete."""
    fs, p = _at(spark, f"{path}/_SUCCESS")
    fs.create(p, True).close()


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder where all executors can write."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{shared}/files-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new shared folder for the length of a job; what is wanted of it has to be materialised before."""
    path = new_folder(spark)
    try:
        yield path
    finally:
        remove(spark, path)
