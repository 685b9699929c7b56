"""One row per column: class, missing values, distinct values, text length."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    BOOLEAN,
    DATETIME,
    NESTED,
    NUMERIC,
    STRING,
    col,
    columns_of,
    flat_columns,
    kind_of,
    rows_to_frame,
    tidy,
    unfold,
)

PROFILE_SCHEMA = (
    "column string, position int, kind string, dtype string, rows bigint, "
    "missing bigint, distinct bigint, avg_length double"
)

#: HLL with 2^16 registers has a relative standard error of about 0.4 percent
SKETCH_BITS = 16
SKETCH_MARGIN = 0.025
FEW_VALUES = 32


def missing_counts(df: DataFrame) -> DataFrame:
    """``column, position, dtype, missing`` in one aggregate."""
    df = tidy(df)
    aggregated = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    types = dict(df.dtypes)
    return unfold(
        aggregated,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                F.lit(types[c]).alias("dtype"),
                F.col(f"m{i}").alias("missing"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column, position, distinct``: exact, NULL not counted."""
    df = tidy(df)
    names = flat_columns(df)
    types = dict(df.dtypes)
    aggregated = df.agg(*[F.count_distinct(_identity(c, types[c])).alias(f"d{i}") for i, c in enumerate(names)])
    places = {c: i for i, c in enumerate(df.columns)}
    return unfold(
        aggregated,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(places[c]).alias("position"),
                F.col(f"d{i}").alias("distinct"),
            )
            for i, c in enumerate(names)
        ],
    )


def _identity(name: str, dtype: str):
    """What stands for a value among distinct ones: long texts by a digest, as whole texts
    would be shuffled otherwise."""
    value = col(name)
    return F.when(F.length(value) > 32, F.md5(value)).otherwise(value) if dtype == "string" else value


def column_profile(df: DataFrame, distinct: str = "auto") -> DataFrame:
    """The facts every rule of the advisor, leakage and schema operators reads.

    ``distinct="exact"`` counts distinct values of all columns in one aggregate, which
    shuffles every distinct value once. ``"sketch"`` estimates them in the same pass as
    the null counts (no data shuffle) and recounts exactly the columns whose estimate
    lies near a value a rule compares with, so the rules decide as with exact counts.
    ``"auto"`` counts exactly, at every size.
    """
    if distinct not in ("auto", "exact", "sketch"):
        raise ValueError("distinct must be 'auto', 'exact' or 'sketch'")
    df = tidy(df)
    if distinct == "sketch":
        return _sketched_profile(df)
    # kept apart from the distinct counts: one aggregate over both would send every
    # value through the rows that the distinct counts multiply
    base = unfold(
        df.agg(*_base_aggregates(df)),
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(kind_of(f.dataType)).alias("kind"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                (F.col(f"l{i}") if kind_of(f.dataType) == STRING else F.lit(None).cast("double")).alias("avg_length"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )
    counts = F.broadcast(distinct_counts(df).select("position", "distinct"))  # one row per column
    return base.join(counts, "position", "left").select(
        "column", "position", "kind", "dtype", "rows", "missing", "distinct", "avg_length"
    )


def _base_aggregates(df: DataFrame) -> list:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        out.append(F.count(col(f.name)).alias(f"n{i}"))
        if kind_of(f.dataType) == STRING:
            out.append(F.avg(F.length(col(f.name))).alias(f"l{i}"))
    return out


def _sketched_profile(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    flat = [i for i, f in enumerate(fields) if kind_of(f.dataType) != NESTED]
    sketches = []
    for i in flat:
        value = col(fields[i].name)
        hashed = F.when(value.isNotNull(), F.xxhash64(value))
        sketches.append(
            F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS))).alias(f"d{i}")
        )
    seen = df.agg(*_base_aggregates(df), *sketches).first().asDict()
    rows = seen["rows"]
    counts = {i: min(seen[f"d{i}"] or 0, seen[f"n{i}"]) for i in flat}
    near = [i for i in flat if _near_an_edge(counts[i], rows, kind_of(fields[i].dataType))]
    if near:
        # a column of a few dozen values is counted by the set of them, which is as small
        # as the estimate says and moves no rows
        few = [i for i in near if counts[i] <= FEW_VALUES]
        recount = df.agg(
            *[
                (F.size(F.collect_set(col(fields[i].name))) if i in few else F.count_distinct(col(fields[i].name)))
                .cast("bigint")
                .alias(f"d{i}")
                for i in near
            ]
        ).first()
        counts.update({i: recount[f"d{i}"] for i in near})
    out = [
        (
            f.name, i, kind_of(f.dataType), f.dataType.simpleString(), rows,
            rows - seen[f"n{i}"], counts.get(i), seen.get(f"l{i}"),
        )
        for i, f in enumerate(fields)
    ]
    return rows_to_frame(df.sparkSession, out, PROFILE_SCHEMA)


def _near_an_edge(estimate: int, rows: int, kind: str) -> bool:
    """Whether a rule could decide otherwise with the exact count: rules compare the
    count with 1 to 20 and, for strings, its share of the rows with 0.5 and 0.95."""
    if estimate <= FEW_VALUES:
        return True
    if kind != STRING or rows == 0:
        return False
    share = estimate / rows
    return any(abs(share - edge) <= SKETCH_MARGIN * max(edge, share) for edge in (0.5, 0.95))


# -- column classes ---------------------------------------------------------------

#: a string column is free text above this mean length and share of distinct values
TEXT_LENGTH = 40
TEXT_DISTINCT_SHARE = 0.5
TEXT_SAMPLE = 30


def column_classes(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    distinct: str = "auto",
    profile: DataFrame | None = None,
) -> DataFrame:
    """``column, position, column_class, dtype, missing, distinct``.

    The text rule looks at the mean length of a string column: over its first 30
    non-null values in ``order_by`` order, or, where no order is given, over all its
    values, since a table has no order of its own.
    """
    df = tidy(df)
    facts = profile if profile is not None else column_profile(df, distinct)
    strings = columns_of(df, STRING)
    if order_by and strings:
        # one row per string column, so small enough to broadcast whatever the table
        sample = F.broadcast(_first_lengths(df, strings, list(order_by)))
        facts = facts.join(sample, "column", "left").withColumn("avg_length", F.col("first_length"))
    share = F.col("distinct") / F.greatest(F.col("rows"), F.lit(1))
    is_text = (
        (F.col("kind") == STRING)
        & (F.col("avg_length") > TEXT_LENGTH)
        & (share > TEXT_DISTINCT_SHARE)
    )
    return facts.select(
        "column",
        "position",
        F.when(F.col("kind") == NUMERIC, "numeric")
        .when(F.coalesce(is_text, F.lit(False)), "text")
        .when(F.col("kind").isin(STRING, BOOLEAN), "categorical")
        .when(F.col("kind") == DATETIME, "datetime")
        .otherwise("nested")
        .alias("column_class"),
        "dtype",
        "missing",
        "distinct",
    )


def _first_lengths(df: DataFrame, strings: list[str], order_by: list[str]) -> DataFrame:
    # one scan for all columns; Spark cuts each task's rows to 30 per column before the shuffle
    keys = [col(k).alias(f"_key{i}") for i, k in enumerate(order_by)]
    each = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.length(col(n)).alias("n")) for n in strings])).alias("s")
    ).select(*[f"_key{i}" for i in range(len(keys))], "s.column", "s.n").where("n IS NOT NULL")
    order = Window.partitionBy("column").orderBy(*[F.asc(f"_key{i}") for i in range(len(keys))])
    first = each.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= TEXT_SAMPLE)
    return first.groupBy("column").agg(F.avg("n").alias("first_length"))


# Date forms tried on text columns, most specific first.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy",
    "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
]

#: a text column whose values parse as dates above this share of all rows is a date
DATE_SHARE = 0.7
CATEGORY_DISTINCT_SHARE = 0.5


_SHAPES = {
    "yyyy": r"\d{4}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}",
    "ss": r"\d{2}", "SSSSSS": r"\d{1,6}", "XXX": r"(Z|[+-]\d{2}:\d{2})", "M": r"\d{1,2}", "d": r"\d{1,2}",
}


def _shape(form: str) -> str:
    """Pattern of the texts a date form can read; most texts fail it far faster than a
    date parser does."""
    parts = re.findall(r"'T'|([A-Za-z])(\1*)|([^A-Za-z])", form)
    out = []
    for letter, more, other in parts:
        out.append("T" if not letter and not other else re.escape(other) if other else _SHAPES[letter + more])
    return "^" + "".join(out) + "$"


def parsed_date(name: str):
    """First date form that fits the text; tried only on texts short enough to be one."""
    text = F.trim(col(name))
    attempts = [F.when(text.rlike(_shape(form)), F.try_to_timestamp(text, F.lit(form))) for form in DATE_FORMATS]
    return F.when(F.length(text).between(6, 40) & text.rlike(r"\d"), F.coalesce(*attempts))


def parse_aware_classes(df: DataFrame) -> DataFrame:
    """Column classes where text holding dates counts as datetime.

    Numbers and booleans are numeric; a string column is datetime if over 70 percent
    of all rows parse, else categorical below a distinct share of 0.5, else text.
    Columns: ``column, position, column_class, missing``.
    """
    df = tidy(df)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    texts = [f.name for f in df.schema.fields if kind_of(f.dataType) == STRING]
    for i, f in enumerate(df.schema.fields):
        aggregates.append(F.count(col(f.name)).alias(f"n{i}"))
        if f.name in texts:
            aggregates.append(F.count(parsed_date(f.name)).alias(f"p{i}"))
    # parsed texts are counted where they lie; distinct ones by digests, in a pass of their own
    rows = F.greatest(F.col("rows"), F.lit(1))
    structs = []
    for i, f in enumerate(df.schema.fields):
        kind = kind_of(f.dataType)
        if kind in (NUMERIC, BOOLEAN):
            found = F.lit("numeric")
        elif kind == DATETIME:
            found = F.lit("datetime")
        elif kind == STRING:
            found = F.when(F.col(f"p{i}") / rows > DATE_SHARE, "datetime").otherwise("text")
        else:
            found = F.lit("nested")
        structs.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                found.alias("column_class"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                rows.alias("rows"),
            )
        )
    base = unfold(df.agg(*aggregates), structs)
    if texts:
        counts = F.broadcast(distinct_counts(df.select(*map(col, texts))).select("column", "distinct"))  # one row per column
        base = base.join(counts, "column", "left")
    else:
        base = base.withColumn("distinct", F.lit(None).cast("bigint"))
    few = (F.col("column_class") == "text") & (F.col("distinct") / F.col("rows") < CATEGORY_DISTINCT_SHARE)
    found = F.when(few, "categorical").otherwise(F.col("column_class"))
    return base.select("column", "position", found.alias("column_class"), "missing")
