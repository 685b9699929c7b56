"""Where queries are registered, and SQL fragments their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the labels some of them have, so with real missing values."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    joined = documents.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", (joined["toxic"] == 1).alias("is_toxic")
    )


LABELLED = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.toxic = 1 AS is_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labelled": ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "is_toxic"],
}

KINDS = {
    "o_orderstatus": "string", "o_orderdate": "datetime", "o_orderpriority": "string",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
    "c_name": "string", "c_mktsegment": "string", "p_name": "string", "p_brand": "string", "p_type": "string",
    "ts": "datetime", "event_type": "string", "props": "string", "text": "string", "lang": "string",
    "source": "string", "is_toxic": "boolean",
}


def per_column(name: str, columns: list[str], select: str, source: str | None = None) -> str:
    """UNION ALL of one aggregate per column; ``{c}``, ``{i}``, ``{kind}`` are filled in."""
    body = source or name
    parts = []
    for c in columns:
        i = COLUMNS[name].index(c)
        filled = select.format(c=c, i=i, kind=KINDS.get(c, "numeric"))
        parts.append(f"SELECT '{c}' AS \"column\", {i}::INTEGER AS position, {filled} FROM {body} AS src")
    return "\nUNION ALL\n".join(parts)


def facts_sql(name: str, source: str | None = None) -> str:
    """One row per column, as the rules of the advice operators read them."""
    return per_column(
        name,
        COLUMNS[name],
        "'{kind}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS dist",
        source,
    )
