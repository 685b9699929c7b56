"""Target advice and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.leakage import (
    IDENTIFIER_WORDS,
    OUTCOME_NAME_WORDS,
    formula_matches,
    leakage_findings,
    leakage_report,
    leakage_risk,
    target_evidence,
)
from tablewright.operators.targets import (
    CONTACT_WORDS,
    OUTCOME_WORDS,
    recommend_targets,
    rejected_targets,
    target_summary,
)
from tablewright.plans.registry import (
    COLUMNS,
    LABELLED,
    facts_sql,
    labelled_documents,
    query,
    table,
)


def _advice_sql(name: str, domain: str, source: str | None = None) -> str:
    contact, outcome = "|".join(CONTACT_WORDS), "|".join(OUTCOME_WORDS[domain])
    return f"""WITH f AS ({facts_sql(name, source)}),
s AS (SELECT *, missing / greatest(n, 1) AS mr, dist / greatest(n, 1) AS dr FROM f),
j AS (SELECT *, CASE WHEN regexp_matches(lower("column"), '{contact}') THEN 'identifier_name'
WHEN dist <= 1 THEN 'constant' WHEN mr > 0.45 THEN 'missing' END AS reason,
50 + CASE WHEN regexp_matches(lower("column"), '{outcome}') THEN 25 ELSE 0 END
+ CASE WHEN dist BETWEEN 2 AND 20 THEN 10 ELSE 0 END - CASE WHEN dr > 0.95 AND kind = 'string' THEN 25 ELSE 0 END
+ CASE WHEN kind IN ('numeric', 'boolean') THEN 8 ELSE 0 END + CASE WHEN mr < 0.05 THEN 7 ELSE 0 END AS points,
CASE WHEN kind IN ('string', 'boolean') OR dist <= 5 THEN 'classification' ELSE 'regression' END AS task_type FROM s),
best AS (SELECT row_number() OVER (ORDER BY least(100, greatest(0, points)) DESC, position)::INTEGER AS "rank", "column", position,
least(100, greatest(0, points))::INTEGER AS score, task_type,
CASE WHEN points >= 75 THEN 'High' WHEN points >= 55 THEN 'Medium' ELSE 'Low' END AS priority FROM j WHERE reason IS NULL)
"""


_RANKED = "SELECT * FROM best"
_REJECTED = 'SELECT "column", position, reason FROM j WHERE reason IS NOT NULL'


@query(_advice_sql("orders", "business") + _RANKED)
def target_advice(spark, folder):
    return recommend_targets(table(spark, folder, "orders"), "business").drop("reasons", "warnings")


@query(_advice_sql("lineitem", "finance") + _RANKED)
def target_advice_from_sketches(spark, folder):
    """The path for large tables: sketched distinct counts, exact near a rule's edge."""
    return recommend_targets(table(spark, folder, "lineitem"), "finance", distinct="sketch").drop("reasons", "warnings")


@query(_advice_sql("labelled", "research", LABELLED) + _REJECTED)
def target_rejections(spark, folder):
    return rejected_targets(labelled_documents(spark, folder), "research")


@query(
    _advice_sql("part", "business")
    + """SELECT 0::INTEGER AS position, 'target=' || "column" AS statement FROM best WHERE "rank" = 1
UNION ALL SELECT 1, 'score=' || score || '/100' FROM best WHERE "rank" = 1
UNION ALL SELECT 2, 'task=' || task_type FROM best WHERE "rank" = 1"""
)
def target_statements(spark, folder):
    return target_summary(recommend_targets(table(spark, folder, "part"), "business"))


def _items(spark, folder):
    """Line items with a planted leak: the gross amount is price times quantity."""
    return table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("gross"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("copy_of_gross"),
        (F.col("l_extendedprice") * F.col("l_quantity") + F.col("l_tax")).cast("string").alias("gross_text"),
    )


_ITEMS = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
l_extendedprice * l_quantity AS gross, l_extendedprice * l_quantity AS copy_of_gross,
l_extendedprice * l_quantity + l_tax AS gross_text FROM lineitem)"""

_EVIDENCE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {same} AS same, {'NULL::DOUBLE' if c.endswith(('flag', 'status')) else f'round(corr({c}, gross), 4)'} AS correlation FROM src"
    for c, same in [
        ("l_quantity", "bool_and(l_quantity IS NOT DISTINCT FROM gross)"),
        ("l_extendedprice", "bool_and(l_extendedprice IS NOT DISTINCT FROM gross)"),
        ("l_discount", "bool_and(l_discount IS NOT DISTINCT FROM gross)"),
        ("l_tax", "bool_and(l_tax IS NOT DISTINCT FROM gross)"),
        ("l_returnflag", "bool_and(false)"),
        ("l_linestatus", "bool_and(false)"),
        ("copy_of_gross", "bool_and(copy_of_gross IS NOT DISTINCT FROM gross)"),
        ("gross_text", "bool_and(false)"),
    ]
)


@query(f"WITH src AS {_ITEMS} {_EVIDENCE}")
def leakage_evidence(spark, folder):
    return target_evidence(_items(spark, folder), "gross")


def _formula_sql(columns: list[str], target: str) -> str:
    parts = []
    pair = 0
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            forms = [(f"{a} + {b}", f"{a} + {b}"), (f"{a} - {b}", f"{a} - {b}"), (f"{b} - {a}", f"{b} - {a}"), (f"{a} * {b}", f"{a} * {b}")]
            for k, (text, expr) in enumerate(forms):
                parts.append(
                    f"SELECT {pair * 4 + k}::INTEGER AS ordinal, '{text}' AS formula, count(v) AS valid, "
                    f"count_if(abs(t - v) / greatest(abs(t), 1) < 0.01)::BIGINT AS matched, "
                    f"round(avg(CASE WHEN abs(t - v) / greatest(abs(t), 1) < 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS match_share "
                    f"FROM (SELECT {target} AS t, {expr} AS v FROM src)"
                )
            pair += 1
    return " UNION ALL ".join(parts)


_ITEM_FORMULAS = _formula_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "copy_of_gross"], "gross")


@query(f"WITH src AS {_ITEMS} {_ITEM_FORMULAS}")
def leakage_formulas(spark, folder):
    found = formula_matches(_items(spark, folder), "gross")
    return found.withColumn("match_share", F.round("match_share", 4))


def _findings_sql(source: str, columns: list[str], texts: list[str], evidence: str, formulas: str | None) -> str:
    """Findings by the rules, from the data: ``feature, type, severity, evidence``."""
    identifier, outcome = "|".join(IDENTIFIER_WORDS), "|".join(OUTCOME_NAME_WORDS)
    distinct = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS dist, count(*) AS n, {str(c in texts).lower()} AS is_text FROM src" for c in columns
    )
    matches = "" if formulas is None else """
UNION ALL SELECT formula, 'arithmetic_leakage', 'High', printf('%.2f%% of rows match within 1%%', share * 100)
FROM (SELECT formula, valid, matched / valid AS share FROM fm WHERE valid >= 10) WHERE share >= 0.85"""
    return f"""WITH src AS {source}, ev AS ({evidence}), dc AS ({distinct}){f", fm AS ({formulas})" if formulas else ""},
found AS (SELECT "column" AS feature, 'identifier_feature' AS type, 'Medium' AS severity, dist || ' distinct values in ' || n || ' rows' AS evidence
FROM dc WHERE regexp_matches(lower("column"), '{identifier}') OR (is_text AND dist / n > 0.95)
UNION ALL SELECT "column", 'target_like_feature_name', 'High', 'the name speaks of an outcome' FROM dc WHERE regexp_matches(lower("column"), '{outcome}')
UNION ALL SELECT "column", 'duplicate_target', 'Critical', 'all values equal the target''s' FROM ev WHERE same
UNION ALL SELECT "column", 'high_correlation', 'High', 'correlation ' || correlation FROM ev WHERE abs(correlation) >= 0.95{matches}),
scored AS (SELECT count(*) AS findings,
least(100, coalesce(sum(CASE severity WHEN 'Critical' THEN 40 WHEN 'High' THEN 25 WHEN 'Medium' THEN 10 ELSE 5 END), 0))::BIGINT AS risk_score FROM found),
risk AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'Critical' WHEN risk_score >= 40 THEN 'High' WHEN risk_score >= 20 THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored)
"""


_FINDINGS = _findings_sql(
    _ITEMS, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "copy_of_gross", "gross_text"],
    ["l_returnflag", "l_linestatus", "gross_text"], _EVIDENCE, _ITEM_FORMULAS,
)


@query(_FINDINGS + "SELECT * FROM found")
def leakage_checks(spark, folder):
    return leakage_findings(_items(spark, folder), "gross").select("feature", "type", "severity", "evidence")


@query(_FINDINGS + "SELECT findings, risk_score, risk_level FROM risk")
def leakage_score(spark, folder):
    return leakage_risk(leakage_findings(_items(spark, folder), "gross", distinct="sketch"))


_LABEL_COLUMNS = ["doc_id", "lang", "source", "n_chars", "toxic", "is_toxic"]
_LABEL_EVIDENCE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {f'bool_and({c} IS NOT DISTINCT FROM quality)' if c == 'toxic' else 'false'} AS same, {corr} AS correlation FROM src"
    for c, corr in [
        ("doc_id", "round(corr(doc_id, quality), 4)"), ("lang", "NULL::DOUBLE"), ("source", "NULL::DOUBLE"),
        ("n_chars", "round(corr(n_chars, quality), 4)"), ("toxic", "round(corr(toxic, quality), 4)"), ("is_toxic", "round(corr(is_toxic::INT, quality), 4)"),
    ]
)


@query(
    _findings_sql(LABELLED, _LABEL_COLUMNS, ["lang", "source"], _LABEL_EVIDENCE, _formula_sql(["doc_id", "n_chars", "toxic"], "quality"))
    + """SELECT 'quality' AS target, (SELECT count(*) FROM src) AS rows_checked, 7::INTEGER AS columns_checked, risk_score, risk_level, findings,
'level=' || risk_level || ' score=' || risk_score || '/100 findings=' || findings || ' trust='
|| CASE WHEN risk_score >= 40 THEN 'low' WHEN risk_score >= 20 THEN 'after review' ELSE 'as measured' END AS summary,
CASE WHEN (SELECT count(*) FROM src) < 20 THEN 'rows<20' ELSE '' END AS warnings FROM risk"""
)
def leakage_overview(spark, folder):
    report = leakage_report(labelled_documents(spark, folder), "quality")
    return report.withColumn("summary", F.array_join("summary", " ")).withColumn("warnings", F.array_join("warnings", " "))
