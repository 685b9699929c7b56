"""Dense numbers for the rows of a table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import ensure_checkpoint_dir


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place", within: str | None = None) -> DataFrame:
    """The rows with their place, from 0, in ``order`` (unique; ties fall anyhow).

    Partitions are ranges of the order, so a row's place is that in its partition after the
    sizes of the partitions before. With ``within`` places begin anew at each value of that
    column, which the order has to begin with; it should have few values. The driver sees a
    row per partition and value.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", at).checkpoint()
    group = [within] if within else []
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    starts, before = [], {}
    for r in sorted(sizes.collect(), key=lambda r: r["_part"]):
        key = tuple(r[g] for g in group)
        starts.append((*key, r["_part"], before.get(key, 0) - r["first"]))
        before[key] = before.get(key, 0) + r["n"]
    fields = [f"`{within}` {dict(df.dtypes)[within]}"] if within else []
    offsets = df.sparkSession.createDataFrame(starts, ", ".join([*fields, "_part int", "_offset bigint"]))
    joined = placed.join(F.broadcast(offsets), [*group, "_part"])
    return joined.select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))
