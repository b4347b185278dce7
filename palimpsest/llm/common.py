"""Shared pieces: reading tables, cutting lineage, adding columns with Arrow functions."""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.staging import clean, dropped, own_dir, shared_dir, staged

__all__ = ["clean", "dropped", "free_name", "own_dir", "parts_for", "released", "shared_dir", "short_list", "staged", "table", "with_struct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _trim():
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)


def released() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


#: Keys that are broadcast at most: 16 MB of them.
MOST_BROADCAST = 1 << 20


def short_list(keys: DataFrame) -> DataFrame:
    """keys (a column or two of a written table) to be broadcast if there are at most MOST_BROADCAST of them, else as it is.

    A join with a short list then doesn't shuffle the texts of the other side; the result is the same.
    """
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_struct(df: DataFrame, made, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and the fields of the struct column `made`.

    A field replaces an input column of the same name.
    """
    one = free_name(df, "_made")
    names = {f.lower() for f in fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in names]
    return df.withColumn(one, made).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{one}.{f}").alias(f) for f in fields))


def parts_for(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
