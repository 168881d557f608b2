"""Table reads and writes on versioned Parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A whole table; splits, column pruning and filters are up to the reader."""
    return spark.read.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_by_key(existing: DataFrame, new: DataFrame, *, key: str | Sequence[str]) -> DataFrame:
    """Existing rows replaced by new rows of the same key, plus new keys.

    ``new`` must be unique in the key. One anti join; the existing table is
    neither sorted nor collected.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table version next to the older ones, so readers never see a half-written table."""
    path = f"{root.rstrip('/')}/version={version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path
