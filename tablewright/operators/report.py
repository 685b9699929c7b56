"""The tables of a report as one long frame: ``section, position, key, value``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import col

FINDINGS_SHOWN = 15
PREVIEW_SHOWN = 12


def _pairs(section: str, frame: DataFrame, offset: int = 0) -> DataFrame:
    """Columns of a one-row frame as key and value lines."""
    names = frame.columns
    structs = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(offset + i).alias("position"),
            F.lit(c).alias("key"),
            col(c).cast("string").alias("value"),
        )
        for i, c in enumerate(names)
    ]
    return frame.select(F.inline(F.array(*structs)))


def _lines(section: str, key: str, frame: DataFrame, offset: int) -> DataFrame:
    """``position, statement`` frames as lines."""
    return frame.select(
        F.lit(section).alias("section"), (F.col("position") + offset).alias("position"), F.lit(key).alias("key"),
        F.col("statement").alias("value"),
    )


def _table(section: str, key: str, head: DataFrame, offset: int) -> DataFrame:
    """Rows of a short frame as JSON lines; ``_row`` orders them."""
    return head.select(
        F.lit(section).alias("section"), (F.col("_row") + offset).alias("position"), F.lit(key).alias("key"),
        F.to_json(F.struct(*[col(c) for c in head.columns if c != "_row"])).alias("value"),
    )


def _head(frame: DataFrame, order_by: list[str], n: int) -> DataFrame:
    first = frame.orderBy(*[F.asc(col(c)) for c in order_by]).limit(n)
    return first.withColumn("_row", F.row_number().over(Window.orderBy(*[F.asc(col(c)) for c in order_by])))  # n rows


def report_tables(
    quality: DataFrame,
    classes: DataFrame,
    statements: DataFrame | None = None,
    insights: DataFrame | None = None,
    targets: DataFrame | None = None,
    training=None,
    leaderboard: DataFrame | None = None,
    leakage: DataFrame | None = None,
    findings: DataFrame | None = None,
    scored_preview: DataFrame | None = None,
    external: DataFrame | None = None,
    preview_order: list[str] | None = None,
) -> DataFrame:
    """Sections that were computed; those that were not are left out."""
    spark = quality.sparkSession
    parts = [_pairs("overview", quality)]
    if statements is not None:
        parts.append(_lines("overview", "dataset", statements, 100))
    if insights is not None:
        parts.append(_lines("overview", "domain", insights.select("position", "statement"), 200))
    parts.append(
        _pairs(
            "schema",
            classes.agg(
                *[
                    F.count_if(F.col("column_class") == c).alias(f"{c}_columns")
                    for c in ("numeric", "categorical", "datetime", "text")
                ]
            ),
        )
    )
    if targets is not None:
        best = targets.filter(F.col("rank") == 1)
        parts.append(
            _pairs("target", best.select(
                "column", "task_type", "score", "priority", F.array_join("reasons", "; ").alias("reasons"),
                F.array_join("warnings", "; ").alias("warnings"),
            ))
        )
    if training is not None:
        about = training.model
        parts.append(_pairs("training", spark.createDataFrame(
            [(about.model_id, about.algorithm, about.task_type, about.target)],
            "model_id string, algorithm string, task_type string, target string",
        )))
        parts.append(_pairs("training", training.metrics.drop("rows"), 100))
        parts.append(_lines("training", "explanation", training.explanation, 200))
    if leaderboard is not None:
        parts.append(_table("comparison", "model", leaderboard.select(
            F.col("rank").alias("_row"), "algorithm", "score", "fidelity"
        ), 0))
    if leakage is not None:
        parts.append(_pairs("leakage", leakage.select("risk_level", "risk_score", "findings", "rows_checked")))
        parts.append(leakage.select(F.posexplode("summary").alias("position", "value")).select(
            F.lit("leakage").alias("section"), (F.col("position") + 100).alias("position"), F.lit("summary").alias("key"), "value"
        ))
    if findings is not None:
        parts.append(_table("leakage", "finding", _head(findings, ["ordinal"], FINDINGS_SHOWN).drop("ordinal", "evidence"), 200))
    if external is not None:
        parts.append(_pairs("prediction", external))
    if scored_preview is not None:
        parts.append(_table("prediction", "row", _head(scored_preview, preview_order or scored_preview.columns[:1], PREVIEW_SHOWN), 100))
    return reduce(DataFrame.unionByName, parts)
