"""Missing cells, duplicate rows and the quality score built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, tidy


def table_quality(df: DataFrame, compare: str = "digest") -> DataFrame:
    """One row: rows, columns, missing_cells, duplicate_rows, both scores and the grade.

    A duplicate is a row equal to another in every column, NULL equal to NULL; each
    group of equal rows counts all but one. ``compare="digest"`` groups rows by a
    128-bit digest, so 16 bytes per row are shuffled rather than the row itself; two
    unequal rows among 10^13 meet with a chance below 10^-12. ``compare="values"``
    groups by the values. Either way equal rows are counted before the shuffle, so one
    row repeated over a third of the table is no hot spot.
    """
    df = tidy(df)
    width = len(df.columns)
    nulls = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("_nulls")
    if compare == "digest":
        keyed = df.select(*row_digest(df), nulls)
        keys = ["_digest_a", "_digest_b"]
    elif compare == "values":
        keyed = df.select(*[col(c).alias(f"_v{i}") for i, c in enumerate(df.columns)], nulls)
        keys = [f"_v{i}" for i in range(width)]
    else:
        raise ValueError("compare must be 'digest' or 'values'")
    totals = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_nulls").alias("nulls"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("nulls"), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn("columns", F.lit(width).cast("bigint"))
    )
    return score_quality(totals)


def row_digest(df: DataFrame) -> list:
    """Two independent 64-bit hashes of a row. A NULL leaves a running hash as it is,
    so each column's null flag is hashed with it."""
    parts = []
    for c in df.columns:
        parts += [col(c).isNull(), col(c)]
    return [
        F.xxhash64(F.lit(17), *parts).alias("_digest_a"),
        F.xxhash64(F.lit(7919), *parts).alias("_digest_b"),
    ]


def score_quality(totals: DataFrame) -> DataFrame:
    """Scores from ``rows, columns, missing_cells, duplicate_rows``."""
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    rows = F.greatest(F.col("rows"), F.lit(1))
    missing, repeated = F.col("missing_cells") / cells, F.col("duplicate_rows") / rows
    score = F.greatest(F.lit(0.0), F.round(100 - missing * 45 - repeated * 25, 2))
    capped = F.round(
        F.greatest(100 - F.least(missing * 100, F.lit(40.0)) - F.least(repeated * 100, F.lit(20.0)), F.lit(0.0)), 2
    )
    scored = totals.withColumn("quality_score", score)
    return scored.select(
        "rows",
        "columns",
        "missing_cells",
        "duplicate_rows",
        "quality_score",
        F.when(F.col("quality_score") >= 85, "Excellent")
        .when(F.col("quality_score") >= 70, "Good")
        .when(F.col("quality_score") >= 55, "Moderate")
        .otherwise("Weak")
        .alias("grade"),
        capped.alias("capped_score"),
    )
