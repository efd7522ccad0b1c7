"""Helpers that the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import fresh_path


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under private names: ``pick(df, key="doc_id")``.

    Operators work on what this returns, so further columns can't clash with theirs.
    """
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*[named(c).alias(name) for name, c in columns.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the folder all executors share, and read again.

    Cuts the lineage: a lost executor costs a read, and what reads the table twice sees the same rows.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_memory() -> None:
    """Gives back to the system what a Python worker no longer uses; workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
