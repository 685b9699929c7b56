"""k nearest neighbours by Euclidean distance, exact at any size, approximate on request.

A small set of known rows, checked by its bytes, is shared with every task. Beyond that
they are put in lists around learned centres (``inverted_file``), and a query meets only
lists that can hold one of its neighbours, or with ``probes`` only those of its nearest
centres. Distances are computed by numpy on blocks inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.inverted_file import FOUND_SCHEMA, InvertedFile, answer, stacked

#: known rows up to this many bytes are sent to every task
SHARED_BYTES = 64_000_000
#: rows of one list
BLOCK_ROWS = 10_000


def nearest(
    known: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shared_bytes: int = SHARED_BYTES,
    block_rows: int = BLOCK_ROWS,
    probes: int | None = None,
) -> DataFrame:
    """``query_id, neighbour_id, label, distance`` of the k nearest known rows per query.

    ``known`` has ``id bigint, label double, vector array<double>`` and ``queries`` has
    ``id, vector``. Equal distances go to the smaller neighbour id. With ``probes`` a table
    too large to share is searched around that many centres per query only, so that some
    neighbours may be missed.
    """
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        raise ValueError("there are no known rows")
    if size["n"] * (size["width"] + 2) * 8 <= shared_bytes:
        return _against_shared(known, queries, k)
    return InvertedFile(known, k, size["n"], size["width"], block_rows).search(queries, probes)


def _workers(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _against_shared(known: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = known.select("id", "label", "vector").toPandas()
    shared = known.sparkSession.sparkContext.broadcast(
        (rows["id"].to_numpy(), rows["label"].to_numpy(dtype=float), np.stack(rows["vector"].to_numpy()))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors = shared.value
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                yield answer(part["id"].to_numpy(), stacked(part["vector"]), ids, labels, vectors, k)

    # a query costs as much as all known rows, so queries are spread over all workers
    spread = queries.select("id", "vector").repartition(_workers(known), "id")
    return spread.mapInPandas(search, FOUND_SCHEMA)


def vote(found: DataFrame) -> DataFrame:
    """``query_id, prediction``: most frequent label among the neighbours, ties to the
    smallest."""
    counts = found.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    # the smallest label among those with the most votes
    return counts.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


def average(found: DataFrame) -> DataFrame:
    """``query_id, prediction``: mean label of the neighbours."""
    return found.groupBy("query_id").agg(F.avg("label").alias("prediction"))
