"""Numeric and categorical summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import (
    category_text,
    col,
    label_columns,
    numeric_columns,
    tidy,
    unfold,
)
from tablewright.functions.layout import working_copy
from tablewright.operators.quantiles import quantiles_and_more

QUARTILES = [0.25, 0.5, 0.75]

#: up to this many values, Spark's in-memory ``percentile`` is the quicker exact way
IN_MEMORY_VALUES = 1_000_000


def numeric_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    quantiles: str = "auto",
    shape: bool = False,
    single_value_spread: float | None = None,
) -> DataFrame:
    """Count, mean, quartiles, spread and range per numeric column; NULL left out.

    Columns without any value are left out. ``std`` and ``variance`` divide by n - 1 and
    are ``single_value_spread`` (NULL by default) for a single value. ``shape`` adds
    population skewness and excess kurtosis. ``quantiles``: ``"memory"`` and
    ``"ranked"`` are both exact, ``"auto"`` picks by table size, ``"sketch"`` is
    approximate and needs one pass in all.
    """
    df = tidy(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    places = {c: i for i, c in enumerate(df.columns)}
    rows = df.count() if quantiles in ("auto", "ranked") else 0
    if quantiles == "auto":
        quantiles = "memory" if rows * len(names) <= IN_MEMORY_VALUES else "ranked"
    values = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        x = F.col(f"x{i}")
        aggregates += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
            F.var_samp(x).alias(f"var{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
        ]
        if quantiles == "memory":
            aggregates.append(F.percentile(x, F.array(*map(F.lit, QUARTILES))).alias(f"q{i}"))
        elif quantiles == "sketch":
            aggregates.append(F.percentile_approx(x, QUARTILES, 10_000).alias(f"q{i}"))
        if shape:
            aggregates += [F.skewness(x).alias(f"skew{i}"), F.kurtosis(x).alias(f"kurt{i}")]

    ranked: dict[str, list[float | None]] = {}
    if quantiles == "ranked" and names:
        # the moments come with the first of the ranking's passes
        numbers = [f"x{i}" for i in range(len(names))]
        with working_copy(values, rows) as copy:
            found, moments = quantiles_and_more(copy, numbers, QUARTILES, aggregates, rows=rows)
        ranked = dict(zip(names, found.values()))
        known = {k: moments[k] for k in ("rows", *[f"{k}{i}" for i in range(len(names)) for k in ("mean", "var", "min", "max")])}
        known.update({f"n{i}": moments[f"n{i}"] for i in range(len(names))})
        if shape:
            known.update({f"{k}{i}": moments[f"{k}{i}"] for i in range(len(names)) for k in ("skew", "kurt")})
        aggregated = df.sparkSession.range(1).select(*[_constant(v).alias(k) for k, v in known.items()])
    else:
        aggregated = values.agg(*aggregates)

    spare = F.lit(single_value_spread).cast("double")
    structs = []
    for i, name in enumerate(names):
        if quantiles == "ranked":
            q1, q2, q3 = (F.lit(v).cast("double") for v in ranked[name])
        else:
            q1, q2, q3 = (F.col(f"q{i}")[j] for j in range(3))
        variance = F.when(F.col(f"n{i}") > 1, F.col(f"var{i}")).otherwise(spare)
        fields = [
            F.lit(name).alias("column"),
            F.lit(places[name]).alias("position"),
            F.col(f"n{i}").alias("count"),
            F.col(f"mean{i}").alias("mean"),
            q2.alias("median"),
            F.sqrt(variance).alias("std"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            q1.alias("q1"),
            q3.alias("q3"),
            variance.alias("variance"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing"),
        ]
        if shape:
            fields += [F.col(f"skew{i}").alias("skewness"), F.col(f"kurt{i}").alias("kurtosis")]
        structs.append(F.struct(*fields))
    return unfold(aggregated, structs).filter(F.col("count") > 0)


def _constant(value):
    return F.lit(value).cast("bigint" if isinstance(value, int) else "double")


#: how a missing value reads among the categories
MISSING_CATEGORY = "nan"


def _category_columns(df: DataFrame) -> list[str]:
    """The columns of labels, without those that hold texts: whole texts are no categories."""
    from tablewright.operators.profile import TEXT_LENGTH, column_classes

    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    lengths = df.agg(*[F.avg(F.length(col(c))).alias(f"l{i}") for i, c in enumerate(strings)]).first() if strings else []
    long = [c for c, n in zip(strings, lengths) if n is not None and n > TEXT_LENGTH]
    texts = set()
    if long:  # only these can be texts, so only they are counted
        classes = column_classes(df.select(*map(col, long)))
        texts = {r["column"] for r in classes.where("column_class = 'text'").collect()}
    return [c for c in label_columns(df) if c not in texts]


def _grouped(df: DataFrame, names: list[str], keep_missing: bool) -> DataFrame:
    """``position, category, n, present``: every category of every column, counted.

    Rows are counted before the shuffle on (column, category), so a category held by a
    third of the rows crosses it once per task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    places = {c: i for i, c in enumerate(df.columns)}
    texts = df.select(*[category_text(c, types[c]).alias(f"c{places[c]}") for c in names])
    long = texts.unpivot([], texts.columns, "place", "value")
    if not keep_missing:
        long = long.filter(F.col("value").isNotNull())
    counted = long.groupBy("place", F.coalesce("value", F.lit(MISSING_CATEGORY)).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("present")
    )
    return counted.select(F.expr("int(substring(place, 2))").alias("position"), "category", "n", "present")


def _top(counted: DataFrame, k: int) -> DataFrame:
    # Spark cuts each task's rows to k per column before this window's shuffle
    order = Window.partitionBy("position").orderBy(F.desc("n"), F.asc("category"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _column_names(df: DataFrame, names: list[str]):
    places = {c: i for i, c in enumerate(df.columns)}
    pairs = [F.lit(v) for c in names for v in (places[c], c)]
    return F.create_map(*pairs)[F.col("position")]


def category_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = 8,
    keep_missing: bool = True,
) -> DataFrame:
    """``column, position, rank, category, count, share``: the k most frequent
    categories per column, ties by category. ``share`` is of all counted rows."""
    df = tidy(df)
    names = list(columns) if columns is not None else _category_columns(df)
    counted = _grouped(df, names, keep_missing)
    totals = counted.groupBy("position").agg(F.sum("n").alias("total"))
    return (
        _top(counted, k)
        .join(F.broadcast(totals), "position")  # one row per column
        .select(
            _column_names(df, names).alias("column"),
            "position",
            "rank",
            "category",
            F.col("n").alias("count"),
            (F.col("n") / F.col("total")).alias("share"),
        )
    )


def categorical_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = 8,
    keep_missing: bool = True,
) -> DataFrame:
    """Per column: distinct values (NULL not counted), top value with its frequency, the
    k most frequent categories and the missing count.

    ``keep_missing`` counts missing values as the category ``nan``; without it they are
    left out, and so are columns that hold nothing else.
    """
    df = tidy(df)
    names = list(columns) if columns is not None else _category_columns(df)
    counted = _grouped(df, names, True)
    totals = counted.groupBy("position").agg(
        F.count_if(F.col("present") > 0).alias("distinct"),
        F.sum(F.col("n") - F.col("present")).alias("missing"),
    )
    if not keep_missing:
        counted = counted.filter(F.col("present") > 0).withColumn("n", F.col("present"))
    tops = (
        _top(counted, k)
        .groupBy("position")
        .agg(
            F.array_sort(
                # "present" is not shown; with it both sides of the join below need the
                # same counts, and Spark computes and shuffles them once
                F.collect_list(F.struct("rank", "category", F.col("n").alias("count"), "present"))
            ).alias("ranked")
        )
    )
    return tops.join(F.broadcast(totals), "position").select(
        _column_names(df, names).alias("column"),
        "position",
        "distinct",
        "missing",
        F.col("ranked")[0]["category"].alias("top_value"),
        F.col("ranked")[0]["count"].alias("top_frequency"),
        F.transform("ranked", lambda r: F.struct(r["category"].alias("category"), r["count"].alias("count"))).alias(
            "top_categories"
        ),
    )
