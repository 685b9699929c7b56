"""Exact top-k of integer inner products by MaxScore.

Components are quantised to integers. A component is a term: its posting list holds the
vectors whose component has the query's sign, and its bound is the most that list can add.
For each query the terms are ordered by bound; those whose bounds together stay under the
k-th best score so far are not essential, as no vector can enter the result by them alone.
Essential lists are traversed block by block of vectors; vectors that can still compete are
probed in the other lists, largest bound first, and leave as soon as they cannot. The limit
rises with every block.

Vectors are dealt into shards and queries into blocks by hash, both of bounded size; a task
searches one shard for one block, and the shards' results are merged per query. Nothing is
broadcast, so queries may grow with the table.

Defined results: vectors that are null or empty, hold a null or non-finite component, or
have a null id take no part; shorter vectors count as filled up with zeros; rows with equal
ids are rows of their own, and a query is not its own result; ties go to the smaller id;
scores beyond a long are given as its limits; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

SCALE = 1024
K = 10
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: vectors of a shard whose essential lists are traversed before the limit is raised
TRAVERSED = 1024
#: sums of products stay exact in doubles up to here
EXACT = 2.0**53


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _whole(x: float) -> int:
    """``floor(1024 * x)``, also where the product has no double; so large an x is whole itself."""
    return int(x) * SCALE if abs(x) > EXACT else math.floor(SCALE * x)


def max_score(query: np.ndarray, columns: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray, k: int, skip: int):
    """Positions and scores of the k best of a shard; ``columns``: a row per component."""
    bounds = np.where(query > 0, query * high, query * low)
    order = np.argsort(bounds)
    running = np.cumsum(bounds[order])
    best_at, best = np.zeros(0, int), np.zeros(0)
    limit = -math.inf
    for begin in range(0, columns.shape[1], TRAVERSED):
        part = slice(begin, min(begin + TRAVERSED, columns.shape[1]))
        free = int(np.searchsorted(running, limit, side="left"))  # these alone stay under the limit
        essential, rest = order[free:], order[:free][::-1]
        score = query[essential] @ columns[essential, part]
        left = running[free - 1] if free else 0
        at = np.flatnonzero(score + left >= limit) + begin
        score = score[at - begin]
        for term in rest:
            if not len(at):
                break
            score = score + query[term] * columns[term, at]
            left -= bounds[term]
            compete = score + left >= limit
            at, score = at[compete], score[compete]
        if 0 <= skip - begin < TRAVERSED:
            other = at != skip
            at, score = at[other], score[other]
        if len(at):
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, score])
            top = np.lexsort((best_at, ids[best_at], -best))[:k]
            best_at, best = best_at[top], best[top]
            if len(best) == k:
                limit = best[-1]
    return best_at, best


def _search(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    if not len(queries) or not len(shard):
        return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
    width = max(queries["v"].map(len).max(), shard["v"].map(len).max())
    shard = shard.sort_values(["vec_id", "row"])
    rows, ids = shard["row"].to_numpy(), shard["vec_id"].to_numpy()
    asked, columns = _matrix(queries["v"], width), np.ascontiguousarray(_matrix(shard["v"], width).T)
    with np.errstate(over="ignore"):
        most = (width * SCALE * SCALE) * (np.abs(asked).max(initial=0) * np.abs(columns).max(initial=0))
    if most >= EXACT:
        whole = np.vectorize(_whole, otypes=[object])
        asked, columns = whole(asked), whole(columns)
    else:
        asked, columns = np.floor(SCALE * asked), np.floor(SCALE * columns)
    zero = np.zeros(1, columns.dtype)[0]
    high, low = np.maximum(columns.max(1), zero), np.minimum(columns.min(1), zero)
    place = {row: i for i, row in enumerate(rows.tolist())}
    out = []
    for row, name, query in zip(queries["row"], queries["vec_id"], asked):
        at, score = max_score(query, columns, high, low, ids, k, place.get(row, -1))
        limits = np.iinfo("i8")
        out.append(
            pd.DataFrame(
                {"query_row": row, "query_id": name, "row": rows[at], "vec_id": ids[at],
                 "score": [min(max(int(s), limits.min), limits.max) for s in score]}
            )
        )
    return pd.concat(out).astype("int64")


def _sound(name: str) -> Column:
    return F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row that ``is_query`` names, its ``k`` rows of highest inner product:
    ``query_id``, ``rank``, ``vec_id``, ``score``."""
    usable = stored(
        vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & _sound("v"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows, asking = usable.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(rows / SHARD_ROWS)), max(1, math.ceil(asking / BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    dealt = usable.select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), shard.alias("shard"))
    asked = usable.where("asks").select("row", "vec_id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return _search(queries, part, k)

    found = (
        asked.groupBy("block", "shard")
        .cogroup(dealt.groupBy("block", "shard"))
        .applyInPandas(search, "query_row long, query_id long, row long, vec_id long, score long")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's queries: ids divisible by 100."""
    return top_k(embeddings, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r
), k AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
