"""Column classes and null-safe expressions.

Names in data files may hold dots or spaces, so every reference to a data column
goes through :func:`col`, which quotes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
BOOLEAN = "boolean"
STRING = "string"
DATETIME = "datetime"
NESTED = "nested"

#: text form of a number, as opposed to Spark's wider cast rules (``1d``, ``5f``)
INTEGER_PATTERN = r"^[+-]?\d+$"
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|INF(INITY)?)$"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return NESTED


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def label_columns(df: DataFrame) -> list[str]:
    """String and boolean columns, the ones counted by category."""
    return columns_of(df, STRING, BOOLEAN)


def flat_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC, BOOLEAN, STRING, DATETIME)


def trim_names(df: DataFrame) -> DataFrame:
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"column names repeat after trimming: {repeated}")
    return df if names == df.columns else df.toDF(*names)


def tidy(df: DataFrame) -> DataFrame:
    """Trimmed names and one notion of a missing value: NaN becomes NULL."""
    df = trim_names(df)
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def finite(value: Column) -> Column:
    """The value itself, or NULL where it is infinite or NaN."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def as_double(name: str, dtype: T.DataType) -> Column:
    """Number behind a column of any flat type; NULL where there is none."""
    kind = kind_of(dtype)
    value = col(name)
    if kind == NUMERIC:
        return value.cast("double")
    if kind == BOOLEAN:
        return value.cast("int").cast("double")
    if kind == STRING:
        text = F.trim(value)
        return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    if kind == DATETIME:
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def category_text(name: str, dtype: T.DataType) -> Column:
    """Category as text. Booleans read ``True`` / ``False``; integral numbers carry
    no decimal point, so that class 1 and class 1.0 are one class."""
    kind = kind_of(dtype)
    value = col(name)
    if kind == BOOLEAN:
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 9.0e15)
        return F.when(whole, number.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def contains_any(name: Column, keywords: Iterable[str], word_boundary: bool = False) -> Column:
    """Case-blind search for any keyword; substring match unless ``word_boundary``."""
    body = "|".join(keywords)
    pattern = rf"(^|[^a-z0-9])({body})($|[^a-z0-9])" if word_boundary else body
    return F.lower(name).rlike(pattern)


def rows_to_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small result (one row per column, pair or model) as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def unfold(aggregated: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One-row aggregate to one row per struct, without leaving the plan."""
    return aggregated.select(F.inline(F.array(*structs)))
