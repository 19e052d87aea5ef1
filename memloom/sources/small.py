"""Joins with a side that is expected to be small: broadcast only after its size was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left", limit: int = 100_000) -> DataFrame:
    """Join ``df`` with ``small``, broadcast if it has at most ``limit`` rows, shuffled otherwise."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)


def enough_tasks(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that are heavy for their bytes.

    Stored in one file, a table would otherwise be read by one task; a table of
    many files stays as it is and does not move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, key)
