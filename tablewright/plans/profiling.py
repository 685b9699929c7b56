"""Schema, quality, summary, chart and insight queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.operators.charts import (
    category_chart,
    histogram,
    line_series,
    missing_chart,
    recommend_charts,
    scatter_sample,
    top_groups,
)
from tablewright.operators.correlation import correlation_matrix
from tablewright.operators.insights import dataset_facts, domain_insights, named_column_insights
from tablewright.operators.profile import (
    column_classes,
    column_profile,
    distinct_counts,
    missing_counts,
    parse_aware_classes,
)
from tablewright.operators.quality import table_quality
from tablewright.operators.summary import categorical_summary, category_counts, numeric_summary
from tablewright.plans.registry import (
    COLUMNS,
    LABELLED,
    facts_sql,
    labelled_documents,
    per_column,
    query,
    table,
)
from tablewright.session import remove_at_end, shared_folder
from tablewright.sources.fingerprint import file_hashes
from tablewright.sources.tables import column_types, read_csv, write_table

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _rounded(df, *names, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


# -- sources ----------------------------------------------------------------------


@query(
    per_column(
        "orders",
        COLUMNS["orders"],
        "CASE WHEN '{c}' IN ('o_orderkey', 'o_custkey') THEN 'long' WHEN '{c}' = 'o_totalprice' THEN 'double' "
        "ELSE 'string' END AS inferred, count({c}) AS present, count(DISTINCT {c}) AS dist",
    )
)
def csv_types(spark, folder):
    """Orders written as CSV, read back with types inferred."""
    orders = table(spark, folder, "orders")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_table(orders, path, "csv")
    remove_at_end(spark, path)
    back = read_csv(spark, path)
    counts = distinct_counts(back).select("column", "position", F.col("distinct").alias("dist"))
    rows = missing_counts(back).select("column", "missing")
    types = spark.createDataFrame(column_types(back), "column string, inferred string")
    total = back.count()
    return (
        counts.join(F.broadcast(rows), "column")
        .join(F.broadcast(types), "column")
        .select("column", "position", "inferred", (F.lit(total) - F.col("missing")).alias("present"), "dist")
    )


@query()
def file_fingerprints(spark, folder):
    """SHA-256 of every table file in the folder."""
    hashed = file_hashes(spark, f"{folder}/*.parquet")
    return hashed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "content_hash")


# -- schema and quality -------------------------------------------------------------


@query(per_column("labelled", COLUMNS["labelled"], "count(*) - count({c}) AS missing", LABELLED))
def column_missing(spark, folder):
    return missing_counts(labelled_documents(spark, folder)).select("column", "position", "missing")


@query(per_column("part", COLUMNS["part"], "count(DISTINCT {c}) AS dist"))
def column_distinct(spark, folder):
    return distinct_counts(table(spark, folder, "part")).select("column", "position", F.col("distinct").alias("dist"))


@query(
    per_column(
        "lineitem", COLUMNS["lineitem"],
        "'{kind}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS dist",
    )
)
def column_facts(spark, folder):
    return column_profile(table(spark, folder, "lineitem"), "exact").select(
        "column", "position", "kind", F.col("rows").alias("n"), "missing", F.col("distinct").alias("dist")
    )


_CLASS_CASE = """CASE WHEN f.kind = 'numeric' THEN 'numeric'
WHEN f.kind = 'string' AND {length} > 40 AND f.dist / greatest(f.n, 1) > 0.5 THEN 'text'
WHEN f.kind IN ('string', 'boolean') THEN 'categorical' ELSE 'datetime' END AS column_class"""


@query(
    f"""WITH f AS ({facts_sql('documents')}),
lengths AS (SELECT avg(length("text")) AS len_text, avg(length(lang)) AS len_lang, avg(length("source")) AS len_source FROM documents)
SELECT f."column", f.position, {_CLASS_CASE.format(length="(CASE f.\"column\" WHEN 'text' THEN len_text WHEN 'lang' THEN len_lang WHEN 'source' THEN len_source END)")},
f.missing FROM f CROSS JOIN lengths"""
)
def column_class(spark, folder):
    return column_classes(table(spark, folder, "documents")).select("column", "position", "column_class", "missing")


@query(
    f"""WITH f AS ({facts_sql('events')}),
lengths AS (SELECT (SELECT avg(length(props)) FROM (SELECT props FROM events ORDER BY event_id LIMIT 30)) AS len_props,
(SELECT avg(length(event_type)) FROM (SELECT event_type FROM events ORDER BY event_id LIMIT 30)) AS len_type)
SELECT f."column", f.position, {_CLASS_CASE.format(length="(CASE f.\"column\" WHEN 'props' THEN len_props WHEN 'event_type' THEN len_type END)")},
f.missing FROM f CROSS JOIN lengths"""
)
def column_class_by_first_values(spark, folder):
    classes = column_classes(table(spark, folder, "events"), order_by=["event_id"])
    return classes.select("column", "position", "column_class", "missing")


@query(
    """SELECT 'o_orderkey' AS "column", 0::INTEGER AS position, 'numeric' AS column_class, count(*) - count(o_orderkey) AS missing FROM orders
UNION ALL SELECT 'placed', 1::INTEGER,
CASE WHEN count(try_cast(o_orderdate::VARCHAR AS TIMESTAMP)) / count(*) > 0.7 THEN 'datetime' ELSE 'other' END, count(*) - count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 2::INTEGER,
CASE WHEN count(DISTINCT o_orderpriority) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END, count(*) - count(o_orderpriority) FROM orders
UNION ALL SELECT 'ticket', 3::INTEGER,
CASE WHEN count(DISTINCT 'no ' || o_orderkey) / count(*) < 0.5 THEN 'categorical' ELSE 'text' END, count(*) - count(o_orderkey) FROM orders
UNION ALL SELECT 'open', 4::INTEGER, 'numeric', count(*) - count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderdate', 5::INTEGER, 'datetime', count(*) - count(o_orderdate) FROM orders"""
)
def parsed_date_class(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("string").alias("placed"),
        "o_orderpriority",
        F.concat(F.lit("no "), F.col("o_orderkey").cast("string")).alias("ticket"),
        (F.col("o_orderstatus") == "O").alias("open"),
        "o_orderdate",
    )
    return parse_aware_classes(orders)


def _quality_sql(source: str, columns: list[str]) -> str:
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    listed = ", ".join(columns)
    return f"""WITH raw AS (SELECT {listed} FROM {source} AS src),
t AS (SELECT count(*) AS n, {len(columns)} AS w, {nulls} AS m FROM raw),
u AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT {listed} FROM raw)),
s AS (SELECT n, w, m, n - distinct_rows AS d FROM t CROSS JOIN u),
q AS (SELECT n, w, m, d, greatest(0, round(100 - 45 * (m / greatest(n * w, 1)) - 25 * (d / greatest(n, 1)), 2)) AS score,
round(greatest(100 - least(m / greatest(n * w, 1) * 100, 40) - least(d / greatest(n, 1) * 100, 20), 0), 2) AS capped FROM s)
SELECT n AS "rows", w::BIGINT AS "columns", m::BIGINT AS missing_cells, d::BIGINT AS duplicate_rows, score::DOUBLE AS quality_score,
CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 55 THEN 'Moderate' ELSE 'Weak' END AS grade,
capped::DOUBLE AS capped_score FROM q"""


@query(_quality_sql(LABELLED, ["lang", "source", "quality", "toxic"]))
def quality_with_missing(spark, folder):
    return table_quality(labelled_documents(spark, folder).select("lang", "source", "quality", "toxic"))


@query(_quality_sql("events", ["event_type", "user_id"]))
def quality_with_duplicates(spark, folder):
    return table_quality(table(spark, folder, "events").select("event_type", "user_id"))


@query(_quality_sql("lineitem", COLUMNS["lineitem"]))
def quality_by_values(spark, folder):
    return table_quality(table(spark, folder, "lineitem"), compare="values")


@query(_quality_sql("documents", ["text", "lang"]))
def quality_of_texts(spark, folder):
    return table_quality(table(spark, folder, "documents").select("text", "lang"))


# -- summaries ----------------------------------------------------------------------


def _numeric_sql(name: str, columns: list[str], source: str | None = None, extra: str = "") -> str:
    body = per_column(
        name,
        columns,
        "count({c}) AS \"count\", round(avg({c}), 4) AS mean, round(median({c}), 4)::DOUBLE AS median, "
        "round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", "
        "round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q1, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q3, "
        "count(*) - count({c}) AS missing" + extra,
        source,
    )
    return f'SELECT * FROM ({body}) WHERE "count" > 0'


_NUMERIC = ["column", "position", "count", "mean", "median", "std", "min", "max", "q1", "q3", "missing"]


def _numeric(df, *extra):
    return _rounded(df.select(*_NUMERIC, *extra), "mean", "median", "std", "q1", "q3", *extra)


@query(_numeric_sql("lineitem", LINEITEM_NUMBERS))
def numeric_columns_summary(spark, folder):
    return _numeric(numeric_summary(table(spark, folder, "lineitem")))


@query(_numeric_sql("lineitem", LINEITEM_NUMBERS))
def numeric_summary_by_ranking(spark, folder):
    """The path for large tables: quantiles by bracketing and ranking."""
    return _numeric(numeric_summary(table(spark, folder, "lineitem"), quantiles="ranked"))


@query(_numeric_sql("labelled", ["doc_id", "n_chars", "quality", "toxic"], LABELLED))
def numeric_summary_with_missing(spark, folder):
    return _numeric(numeric_summary(labelled_documents(spark, folder), quantiles="ranked"))


@query(
    _numeric_sql(
        "lineitem",
        ["l_linenumber", "l_quantity", "l_discount", "l_tax"],
        None,
        ", round(var_samp({c}), 4) AS variance, round(kurtosis_pop({c}), 4) AS kurtosis, "
        "round((avg({c}::DOUBLE * {c} * {c}) - 3 * avg({c}) * var_pop({c}) - avg({c}) ** 3) / (stddev_pop({c}) ** 3), 4) AS skewness",
    )
)
def numeric_shape(spark, folder):
    shaped = numeric_summary(
        table(spark, folder, "lineitem"),
        ["l_linenumber", "l_quantity", "l_discount", "l_tax"],
        shape=True,
        single_value_spread=0.0,
    )
    return _numeric(shaped, "variance", "kurtosis", "skewness")


@query()
def numeric_summary_sketched(spark, folder):
    """One pass, approximate quartiles."""
    return numeric_summary(table(spark, folder, "lineitem"), quantiles="sketch")


def _category_text(c: str) -> str:
    return "CASE is_toxic WHEN true THEN 'True' WHEN false THEN 'False' END" if c == "is_toxic" else c


def _counts_sql(name: str, columns: list[str], k: int, source: str | None = None, keep: bool = True) -> str:
    value = "coalesce({v}, 'nan')" if keep else "{v}"
    keepers = "true" if keep else "{v} IS NOT NULL"
    parts = []
    for c in columns:
        i, v = COLUMNS[name].index(c), _category_text(c)
        parts.append(
            f"SELECT '{c}' AS \"column\", {i}::INTEGER AS position, {value.format(v=v)} AS category "
            f"FROM {source or name} AS src WHERE {keepers.format(v=v)}"
        )
    return f"""WITH long AS ({' UNION ALL '.join(parts)}),
counted AS (SELECT "column", position, category, count(*) AS n FROM long GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, category) AS r,
sum(n) OVER (PARTITION BY "column") AS total FROM counted)
SELECT "column", position, r::INTEGER AS "rank", category, n AS "count", round(n / total, 4) AS share FROM ranked WHERE r <= {k}"""


@query(_counts_sql("labelled", ["lang", "source", "is_toxic"], 8, LABELLED))
def top_categories(spark, folder):
    return _rounded(category_counts(labelled_documents(spark, folder)), "share")


@query(_counts_sql("labelled", ["lang", "source", "is_toxic"], 10, LABELLED, keep=False))
def top_categories_present(spark, folder):
    return _rounded(category_counts(labelled_documents(spark, folder), k=10, keep_missing=False), "share")


@query(
    f"""WITH counted AS ({_counts_sql('labelled', ['lang', 'source', 'is_toxic'], 1, LABELLED)}),
f AS ({facts_sql('labelled', LABELLED)})
SELECT c."column", c.position, f.dist, f.missing, c.category AS top_value, c."count" AS top_frequency
FROM counted c JOIN f ON f."column" = c."column" """
)
def categorical_columns_summary(spark, folder):
    return categorical_summary(labelled_documents(spark, folder)).select(
        "column", "position", F.col("distinct").alias("dist"), "missing", "top_value", "top_frequency"
    )


# -- charts -------------------------------------------------------------------------


@query(
    "SELECT * FROM ("
    + per_column("labelled", COLUMNS["labelled"], "count(*) - count({c}) AS missing", LABELLED)
    + ") WHERE missing > 0"
)
def missing_value_chart(spark, folder):
    return missing_chart(labelled_documents(spark, folder))


@query(_counts_sql("orders", ["o_orderstatus", "o_orderpriority"], 8))
def category_bars(spark, folder):
    return _rounded(category_chart(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]), "share")


@query(
    """SELECT "source" AS category, round(avg(n_chars), 4) AS mean FROM documents
WHERE "source" IS NOT NULL GROUP BY "source" ORDER BY avg(n_chars) DESC, "source" LIMIT 10"""
)
def group_mean_top(spark, folder):
    return _rounded(top_groups(table(spark, folder, "documents"), "source", "n_chars"), "mean")


def _histogram_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        i = COLUMNS["lineitem"].index(c)
        parts.append(
            f"""SELECT '{c}' AS "column", {i}::INTEGER AS position, g.b::INTEGER AS bin, round(b.lo + g.b * b.step, 4) AS low,
round(CASE WHEN g.b = b.bins - 1 THEN b.hi ELSE b.lo + (g.b + 1) * b.step END, 4) AS high,
(SELECT count(*) FROM lineitem WHERE {c} >= b.lo + g.b * b.step AND
CASE WHEN g.b = b.bins - 1 THEN {c} <= b.hi ELSE {c} < b.lo + (g.b + 1) * b.step END) AS "count"
FROM (SELECT lo, hi, bins, (hi - lo) / bins AS step FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
least(8, greatest(3, count({c}) // 5)) AS bins FROM lineitem)) b, (SELECT unnest(range(8)) AS b) g WHERE g.b < b.bins"""
        )
    return " UNION ALL ".join(parts)


@query(_histogram_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def histogram_bins(spark, folder):
    bins = histogram(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _rounded(bins.drop("label"), "low", "high")


def _correlation_sql(columns: list[str], source: str) -> str:
    aggregates = ", ".join(
        f"corr({a}::DOUBLE, {b}::DOUBLE) AS c{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns)
    )
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN c{i}_{j} IS NULL OR isnan(c{i}_{j}) THEN 0 ELSE c{i}_{j} END, 4) AS \"value\" FROM m"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    )
    return f"WITH m AS (SELECT {aggregates} FROM {source} AS src) {rows}"


_CORRELATED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_correlation_sql(_CORRELATED, "lineitem"))
def correlations(spark, folder):
    return _rounded(correlation_matrix(table(spark, folder, "lineitem"), _CORRELATED), "value")


@query(
    _correlation_sql(
        ["doc_id", "n_chars", "quality", "toxic", "one"],
        "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic, 1 AS one FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    )
)
def correlations_with_missing(spark, folder):
    frame = labelled_documents(spark, folder).select("doc_id", "n_chars", "quality", "toxic", F.lit(1).alias("one"))
    return _rounded(correlation_matrix(frame), "value")


@query(
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS "index", {c}::DOUBLE AS "value"
FROM orders WHERE {c} IS NOT NULL) WHERE "index" < 50"""
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
)
def line_points(spark, folder):
    return line_series(table(spark, folder, "orders"), ["o_orderkey"])


@query("SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders ORDER BY o_orderkey LIMIT 100")
def scatter_points(spark, folder):
    return scatter_sample(table(spark, folder, "orders"), ["o_orderkey"], "o_custkey", "o_totalprice")


@query(
    f"""WITH f AS ({facts_sql('orders')}), c AS (SELECT "column", position, kind FROM f),
num AS (SELECT list("column" ORDER BY position) AS l FROM c WHERE kind = 'numeric'),
cat AS (SELECT list("column" ORDER BY position) AS l FROM c WHERE kind = 'string'),
dat AS (SELECT list("column" ORDER BY position) AS l FROM c WHERE kind = 'datetime')
SELECT 0::INTEGER AS position, 'bar_chart' AS chart_type, cat.l[1] AS x_axis, num.l[1] AS y_axis FROM num, cat WHERE len(num.l) > 0 AND len(cat.l) > 0
UNION ALL SELECT 1, 'line_chart', dat.l[1], num.l[1] FROM num, dat WHERE len(num.l) > 0 AND len(dat.l) > 0
UNION ALL SELECT 2, 'histogram', num.l[1], NULL FROM num WHERE len(num.l) > 0
UNION ALL SELECT 3, 'scatter_plot', num.l[1], num.l[2] FROM num WHERE len(num.l) > 1
UNION ALL SELECT 4, 'correlation_heatmap', array_to_string(num.l, ', '), array_to_string(num.l, ', ') FROM num WHERE len(num.l) > 1"""
)
def chart_recommendations(spark, folder):
    classes = column_classes(table(spark, folder, "orders"))
    return recommend_charts(classes).select("position", "chart_type", "x_axis", "y_axis")


# -- insights -----------------------------------------------------------------------


@query(
    f"""WITH q AS ({_quality_sql('events', COLUMNS['events'])}),
r AS (SELECT "rows" AS n, "columns" AS w, quality_score AS score, grade, duplicate_rows AS d FROM q)
SELECT 0::INTEGER AS position, 'The dataset has ' || n || ' rows and ' || w || ' columns.' AS statement FROM r
UNION ALL SELECT 1, 'Numeric columns: 3.' FROM r UNION ALL SELECT 2, 'Categorical columns: 2.' FROM r
UNION ALL SELECT 3, 'Data quality is ' || score || ' of 100, grade ' || grade || '.' FROM r
UNION ALL SELECT 4, CASE WHEN d > 0 THEN 'Duplicate rows: ' || d || '.' ELSE 'There are no duplicate rows.' END FROM r"""
)
def dataset_statements(spark, folder):
    events = table(spark, folder, "events")
    return dataset_facts(table_quality(events), column_classes(events))


@query(
    f"""WITH n AS ({_numeric_sql('labelled', ['doc_id', 'n_chars', 'quality', 'toxic'], LABELLED)}),
f AS ({facts_sql('labelled', LABELLED)})
SELECT 0::INTEGER AS position, 'mode' AS topic, NULL AS "column" UNION ALL
SELECT 1, 'highest_mean', (SELECT "column" FROM n ORDER BY mean DESC, position LIMIT 1) UNION ALL
SELECT 2, 'most_diverse', (SELECT "column" FROM f WHERE kind IN ('string', 'boolean') ORDER BY dist DESC, position LIMIT 1) UNION ALL
SELECT 3, 'missing', NULL"""
)
def domain_statements(spark, folder):
    frame = labelled_documents(spark, folder)
    found = domain_insights("business", numeric_summary(frame), categorical_summary(frame), table_quality(frame))
    return found.select("position", "topic", "column")


@query(
    f"""WITH n AS ({_numeric_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])})
SELECT 0::INTEGER AS part, 0::INTEGER AS position, 'mode' AS topic, NULL AS "column", NULL::DOUBLE AS "value"
UNION ALL SELECT 1, 0, 'correlation', NULL, NULL FROM (SELECT count(*) AS k FROM n) WHERE k >= 2
UNION ALL SELECT 2, position, 'spread', "column", round(mean, 2) FROM n"""
)
def research_statements(spark, folder):
    part = table(spark, folder, "part")
    found = named_column_insights("research", numeric_summary(part), categorical_summary(part))
    return found.select("part", "position", "topic", "column", "value")


@query(
    """SELECT 0::INTEGER AS part, 0::INTEGER AS position, 'mode' AS topic, NULL AS "column", NULL::DOUBLE AS "value"
UNION ALL SELECT 1, 1, 'spending', 'supply_cost', round(avg(l_extendedprice * l_discount), 2) FROM lineitem
UNION ALL SELECT 1, 2, 'inflow', 'net_revenue', round(avg(l_extendedprice * (1 - l_discount)), 2) FROM lineitem
UNION ALL SELECT 3, 0, 'notice', NULL, NULL"""
)
def finance_statements(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_quantity",
        (F.col("l_extendedprice") * F.col("l_discount")).alias("supply_cost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_revenue"),
        "l_returnflag",
    )
    found = named_column_insights("finance", numeric_summary(items), categorical_summary(items))
    return found.select("part", "position", "topic", "column", "value")


@query(
    """SELECT 0::INTEGER AS part, 0::INTEGER AS position, 'mode' AS topic, NULL AS "column", NULL::DOUBLE AS "value", NULL AS other
UNION ALL SELECT 1, 0, 'sales', 'net_sales', round(avg(l_extendedprice * (1 - l_discount)), 2), round(max(l_extendedprice * (1 - l_discount)), 2)::VARCHAR FROM lineitem
UNION ALL SELECT 2, 1, 'top_category', 'l_returnflag', NULL, (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 2, 2, 'top_category', 'l_linestatus', NULL, (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
)
def business_statements(spark, folder):
    items = table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_sales"), "l_returnflag", "l_linestatus"
    )
    found = named_column_insights(
        "business", numeric_summary(items), categorical_summary(items, k=10, keep_missing=False)
    )
    return found.select("part", "position", "topic", "column", "value", "other")
