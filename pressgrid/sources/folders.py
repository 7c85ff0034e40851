"""Names and removal of folders in whatever store a path points to."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target) and store.getFileStatus(target).isDirectory()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds the whole output of a finished write."""
    return exists(spark, f"{path}/_SUCCESS")


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The N of all finished `name=N` folders below a path, in order."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return []
    found = [f.getPath().getName() for f in store.listStatus(target)]
    start = f"{name}="
    return sorted(n for n in (int(f[len(start):]) for f in found if f.startswith(start)) if complete(spark, f"{path}/{name}={n}"))


def remove(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern with * in it."""
    store, target = _at(spark, pattern)
    return [f.getPath().toString() for f in store.globStatus(target) or []]


def remove_matching(spark: SparkSession, pattern: str) -> None:
    for path in existing(spark, pattern):
        remove(spark, path)


def fingerprints(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """Per `name=…` folder a digest of its files' names, sizes and times; one entry per folder."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return {}
    out = {}
    for folder in store.listStatus(target):
        label = folder.getPath().getName()
        if folder.isDirectory() and label.startswith(f"{name}="):
            files, found = store.listFiles(folder.getPath(), True), []
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
            out[label.removeprefix(f"{name}=")] = hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
    return out
