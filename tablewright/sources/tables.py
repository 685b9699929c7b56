"""Reading CSV and Parquet into frames the operators accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    INTEGER_PATTERN,
    NUMBER_PATTERN,
    col,
    tidy,
    trim_names,
)

# Texts that mean "missing" in a delimited file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]

#: holds a row's first field beyond the header
OVERFLOW = "_beyond_header"
#: an encoding in which every byte is a character
BYTES = "ISO-8859-1"


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "auto",
    multi_line: bool = False,
    infer_types: bool = True,
) -> DataFrame:
    """CSV with a header row, missing tokens as NULL, and types found in one pass.

    ``encoding="auto"`` reads the bytes once and takes them as UTF-8 if every value is
    valid as such, else as Latin-1. Short rows are filled with NULL, rows with more fields
    than the header are an error. Line breaks inside quotes are looked for first: a file
    that has some is read with ``multi_line``, as it cannot be split over tasks.
    """
    multi_line = multi_line or _breaks_in_quotes(spark, path)
    raw = _strings(spark, path, BYTES if encoding == "auto" else encoding, multi_line)
    if not infer_types and encoding != "auto":
        return raw.drop(OVERFLOW)
    facts = _text_facts(raw)
    if facts["_overflowing"]:
        raise ValueError(f"{facts['_overflowing']} rows have more fields than the header")
    if encoding == "auto" and not facts["_not_utf8"]:
        # the types were found in plain digits and letters, which decoding does not change
        places = {c: f"_c{i}" for i, c in enumerate(raw.columns)}
        raw = raw.toDF(*places.values()).select(
            *[F.decode(F.encode(F.col(p), BYTES), "UTF-8").alias(_decoded(c)) for c, p in places.items()]
        )
    return _typed(raw, facts) if infer_types else raw.drop(OVERFLOW)


def _decoded(name: str) -> str:
    try:
        return name.encode(BYTES).decode("UTF-8").removeprefix("\ufeff").strip()
    except (UnicodeDecodeError, UnicodeEncodeError):
        return name


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a value goes on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(F.pmod(quotes, F.lit(2)) == 1).isEmpty()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return tidy(spark.read.parquet(path))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the dataset has no rows")
    return df


def infer_types(raw: DataFrame) -> DataFrame:
    """Cast a table of strings to the narrowest of long, double, boolean, string.

    Date texts stay strings.
    """
    return _typed(raw, _text_facts(raw))


def _strings(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    header = trim_names(reader.csv(path)).columns
    fields = [T.StructField(c, T.StringType()) for c in (*header, OVERFLOW)]
    # without the extra field, the parser would drop what a row has beyond the header
    raw = reader.schema(T.StructType(fields)).csv(path)
    return raw.select(
        *[F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) for c in raw.columns]
    )


def _text_facts(raw: DataFrame) -> dict:
    names = [c for c in raw.columns if c != OVERFLOW]
    over = F.count(col(OVERFLOW)) if OVERFLOW in raw.columns else F.lit(0)
    checks = [over.alias("_overflowing")]
    for i, name in enumerate(names):
        value, text = col(name), F.trim(col(name))
        is_integer = text.rlike(INTEGER_PATTERN) & text.try_cast("bigint").isNotNull()
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(is_integer).alias(f"i{i}"),
            F.count_if(text.rlike(NUMBER_PATTERN)).alias(f"f{i}"),
            F.count_if(value.isin(TRUE_TEXTS + FALSE_TEXTS)).alias(f"b{i}"),
            F.count_if(~F.is_valid_utf8(F.encode(value, BYTES).cast("string"))).alias(f"u{i}"),
        ]
    row = raw.agg(*checks).first().asDict()
    row["_not_utf8"] = sum(row[f"u{i}"] for i in range(len(names)))
    return row


def _typed(raw: DataFrame, facts: dict) -> DataFrame:
    out = []
    for i, name in enumerate(c for c in raw.columns if c != OVERFLOW):
        value, text, present = col(name), F.trim(col(name)), facts[f"n{i}"]
        if facts[f"i{i}"] == present and present > 0:
            typed = text.try_cast("bigint")
        elif facts[f"f{i}"] == present:  # an all-missing column counts as numeric
            typed = text.try_cast("double")
        elif facts[f"b{i}"] == present:
            typed = F.when(value.isin(TRUE_TEXTS), True).when(value.isin(FALSE_TEXTS), False)
        else:
            typed = value
        out.append(typed.alias(name))
    return raw.select(*out)


def write_table(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write all columns as Parquet or as CSV with a header row."""
    writer = df.write.mode(mode)
    if file_format == "csv":
        # an empty text must not come back as a missing value's quoted twin
        writer.option("header", True).option("escape", '"').csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}; use 'csv' or 'parquet'")


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    names = {T.LongType: "long", T.IntegerType: "long", T.DoubleType: "double",
             T.BooleanType: "boolean", T.StringType: "string"}
    return [(f.name, names.get(type(f.dataType), f.dataType.simpleString())) for f in df.schema.fields]
