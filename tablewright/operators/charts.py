"""Aggregates a chart needs: the data, not the drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import (
    category_text,
    col,
    numeric_columns,
    rows_to_frame,
    tidy,
    unfold,
)
from tablewright.operators.profile import missing_counts
from tablewright.operators.summary import category_counts

CHART_NUMERICS = 4
CHART_CATEGORIES = 3


def missing_chart(df: DataFrame) -> DataFrame:
    """``column, position, missing`` for columns with missing values."""
    return missing_counts(df).filter(F.col("missing") > 0).select("column", "position", "missing")


def category_chart(
    df: DataFrame, categorical: Sequence[str], k: int = 8, max_columns: int = CHART_CATEGORIES
) -> DataFrame:
    """Bar and pie data: top categories of the first few categorical columns."""
    return category_counts(df, list(categorical)[:max_columns], k=k)


def histogram(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_columns: int = CHART_NUMERICS,
    max_bins: int = 8,
) -> DataFrame:
    """``column, position, bin, low, high, count, label`` of equal-width bins.

    ``min(max_bins, max(3, n // 5))`` bins; the last one includes its upper edge, empty
    bins are listed, and a constant column spans one unit around its value. Infinite
    values lie in no bin. Columns with fewer than two values are left out.
    """
    df = tidy(df)
    names = (list(columns) if columns is not None else numeric_columns(df))[:max_columns]
    places = {c: i for i, c in enumerate(df.columns)}
    values = df.select(*[F.when(F.abs(col(c).cast("double")) < float("inf"), col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    bounds = values.agg(
        *[
            e
            for i in range(len(names))
            for e in (
                F.count(F.col(f"x{i}")).alias(f"n{i}"),
                F.min(f"x{i}").alias(f"lo{i}"),
                F.max(f"x{i}").alias(f"hi{i}"),
            )
        ]
    ).first()
    counts, structs = [], []
    for i, name in enumerate(names):
        n = bounds[f"n{i}"]
        if n < 2:
            continue
        edges = bin_edges(bounds[f"lo{i}"], bounds[f"hi{i}"], min(max_bins, max(3, n // 5)))
        x, last = F.col(f"x{i}"), len(edges) - 2
        for b in range(last + 1):
            low, high = edges[b], edges[b + 1]
            upper = x <= F.lit(high) if b == last else x < F.lit(high)
            counts.append(F.count_if((x >= F.lit(low)) & upper).alias(f"c{i}_{b}"))
            structs.append(
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(places[name]).alias("position"),
                    F.lit(b).alias("bin"),
                    F.lit(low).alias("low"),
                    F.lit(high).alias("high"),
                    F.col(f"c{i}_{b}").alias("count"),
                    F.lit(f"{round(low, 2)} - {round(high, 2)}").alias("label"),
                )
            )
    if not structs:
        return rows_to_frame(
            df.sparkSession,
            [],
            "column string, position int, bin int, low double, high double, count bigint, label string",
        )
    return unfold(values.agg(*counts), structs)


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def line_series(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
    n: int = 50,
    max_columns: int = CHART_NUMERICS,
) -> DataFrame:
    """``column, index, value``: the first n non-null values per column in key order.

    Serves line and area charts. Each column is a top-n that every task cuts to n rows
    before anything moves. Columns with fewer than two values are left out.
    """
    df = tidy(df)
    names = (list(columns) if columns is not None else numeric_columns(df))[:max_columns]
    keys = [F.asc(col(k)) for k in order_by]
    parts = None
    for name in names:
        head = (
            df.filter(col(name).isNotNull())
            .select(*[col(k).alias(f"_k{i}") for i, k in enumerate(order_by)], col(name).cast("double").alias("value"))
            .orderBy(*[F.asc(f"_k{i}") for i in range(len(keys))])
            .limit(n)
        )
        whole = Window.orderBy(*[F.asc(f"_k{i}") for i in range(len(keys))])  # over n rows only
        part = (
            head.withColumn("index", F.row_number().over(whole) - 1)
            .withColumn("_size", F.max("index").over(Window.partitionBy()))
            .filter(F.col("_size") >= 1)
            .select(F.lit(name).alias("column"), "index", "value")
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return rows_to_frame(df.sparkSession, [], "column string, index int, value double")
    return parts


def scatter_sample(
    df: DataFrame, order_by: Sequence[str], x: str | None = None, y: str | None = None, n: int = 100
) -> DataFrame:
    """``x, y`` of the first n rows, in key order, that have both values."""
    df = tidy(df)
    numeric = numeric_columns(df)
    if (x is None or y is None) and len(numeric) < 2:
        return rows_to_frame(df.sparkSession, [], "x double, y double")
    x, y = x or numeric[0], y or numeric[1]
    return (
        df.filter(col(x).isNotNull() & col(y).isNotNull())
        .orderBy(*[F.asc(col(k)) for k in order_by])
        .limit(n)
        .select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    )


def top_groups(df: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    """``category, mean``: groups with the highest mean; a missing group is left out and
    a group without values comes last."""
    df = tidy(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return (
        df.filter(col(group).isNotNull())
        .groupBy(category_text(group, types[group]).alias("category"))
        .agg(F.avg(col(value)).alias("mean"))
        .orderBy(F.desc_nulls_last("mean"), F.asc("category"))
        .limit(n)
    )


# Which chart suits which column classes.
CHART_REASONS = {
    "bar_chart": "comparison",
    "line_chart": "course",
    "histogram": "distribution",
    "scatter_plot": "relation",
    "correlation_heatmap": "correlation",
}


def recommend_charts(classes: DataFrame) -> DataFrame:
    """``position, chart_type, x_axis, y_axis, reason`` from a column-class frame.

    ``classes`` has one row per column, so the lists built here are as long as the
    table is wide.
    """
    listed = classes.agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("column_class") == c, F.struct("position", "column")))
                ),
                lambda s: s["column"],
            ).alias(c)
            for c in ("numeric", "categorical", "datetime")
        ]
    )
    numeric, categorical, dates = F.col("numeric"), F.col("categorical"), F.col("datetime")
    some, two = F.size(numeric) > 0, F.size(numeric) > 1
    every = F.array_join(numeric, ", ")
    first = {c: F.get(F.col(c), F.lit(0)) for c in ("numeric", "categorical", "datetime")}
    rules = [
        ("bar_chart", some & (F.size(categorical) > 0), first["categorical"], first["numeric"]),
        ("line_chart", some & (F.size(dates) > 0), first["datetime"], first["numeric"]),
        ("histogram", some, first["numeric"], F.lit(None).cast("string")),
        ("scatter_plot", two, first["numeric"], F.get(numeric, F.lit(1))),
        ("correlation_heatmap", two, every, every),
    ]
    structs = [
        F.when(
            holds,
            F.struct(
                F.lit(i).alias("position"),
                F.lit(kind).alias("chart_type"),
                x.alias("x_axis"),
                y.alias("y_axis"),
                F.lit(CHART_REASONS[kind]).alias("reason"),
            ),
        )
        for i, (kind, holds, x, y) in enumerate(rules)
    ]
    return listed.select(F.inline(F.array_compact(F.array(*structs))))
