"""Folders of stored tables through Hadoop's file system: metadata only, whatever storage the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _handle(spark, path)
    return bool(fs.exists(hpath))


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder (a partition of a stored table) with its files."""
    fs, hpath = _handle(spark, path)
    return bool(fs.delete(hpath, True))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column, as the folder names hold them; no file is opened."""
    fs, hpath = _handle(spark, path)
    prefix = f"{column}="
    names = [s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()] if fs.exists(hpath) else []
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def data_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a path or glob names, also inside the folders it names, in path order; hidden ones left out."""
    fs, hpath = _handle(spark, pattern)
    out, folders = [], [s for s in (fs.globStatus(hpath) or [])]
    while folders:
        status = folders.pop()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            folders.extend(fs.listStatus(status.getPath()))
        else:
            out.append(status.getPath().toString())
    return sorted(out)
