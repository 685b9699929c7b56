"""How a small table is laid out over the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: a table up to this size may be shuffled or kept whole without a second thought
SMALL_ROWS = 5_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A small table held by fewer files than there are cores, dealt out evenly.

    Such a table is often one row group, and so one task, whatever the cores. Dealing it
    out pays where several passes follow. A large table comes in many splits and is left
    as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 10_000 <= rows <= SMALL_ROWS or df.is_cached or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


@contextmanager
def working_copy(df: DataFrame, rows: int) -> Iterator[DataFrame]:
    """For operators of several passes: a small table is spread and kept for their
    length; a large one is read again by each pass, from columns pruned to its need."""
    if not 10_000 <= rows <= SMALL_ROWS:
        yield df
        return
    kept = spread(df, rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
