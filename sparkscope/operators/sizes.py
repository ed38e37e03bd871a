"""Which side of a join may be broadcast: one whose estimated size is under a bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 50_000_000
#: Bytes of a scan for each task that ``spread`` deals it out to.
PIECE = 16 * 1024 * 1024


def estimated(df: DataFrame) -> int:
    """Spark's estimate of a relation's bytes, which is an upper one for scans and filters."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, most: int = MOST_BYTES) -> bool:
    """Whether a relation's estimate is under the bound."""
    return estimated(df) <= most


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small scan, dealt out by ``key`` to all cores, and to a task for each ``PIECE`` bytes: a file of one row group is
    read by one task, which would then do all that follows. A scan of 128 MB for each core or more is left as it is, so
    large tables are not shuffled for it."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, estimated(df)
    return df.repartition(max(cores, math.ceil(size / PIECE)), key) if size <= cores * 128 * 1024 * 1024 else df
