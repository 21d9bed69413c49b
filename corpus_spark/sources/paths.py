"""Paths on any Hadoop file system: existence, first existing, newest match, output names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    file_system, hadoop_path = _hadoop(spark, path)
    return file_system.exists(hadoop_path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; none is an error."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"None of these paths exists: {list(paths)}")


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """The paths that exist, for callers that skip missing inputs."""
    return [path for path in paths if exists(spark, path)]


def newest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The match of a glob that was modified last; a written folder counts by its newest part.

    Equal times go to the greater path. No match is an error.
    """
    file_system, hadoop_path = _hadoop(spark, f"{folder.rstrip('/')}/{pattern}")
    matches = []
    for status in file_system.globStatus(hadoop_path) or []:
        modified = status.getModificationTime()
        if status.isDirectory():
            modified = max([part.getModificationTime() for part in file_system.listStatus(status.getPath())], default=modified)
        matches.append((modified, status.getPath().toString()))
    if not matches:
        raise FileNotFoundError(f"No file matches {pattern!r} in {folder!r}")
    return max(matches)[1]


def prediction_input(spark: SparkSession, folder: str, split: str, path: str | None = None) -> str:
    """The given predictions path, else the newest one of the split."""
    if path is not None:
        return first_existing(spark, path)
    return newest(spark, folder, f"{split}_*.csv")


def prediction_name(split: str, with_adapter: bool = True) -> str:
    """``<split>_lora.csv`` or ``<split>_base.csv``."""
    return f"{split}_{'lora' if with_adapter else 'base'}.csv"


def clean_name(name: str) -> str:
    """``<stem>_clean.csv`` beside its input."""
    head, dot, _ = name.rpartition(".")
    return f"{head if dot else name}_clean.csv"
