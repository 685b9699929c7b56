"""Batch predictions with a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import category_text, col, kind_of, tidy
from tablewright.operators.metrics import confusion_counts, evaluate_predictions
from tablewright.operators.models import PREDICTION
from tablewright.operators.split import ROW_ID, with_row_id
from tablewright.operators.training import DECODED, TrainedModel, named_classes, predict_neighbours
from tablewright.operators.prepare import FEATURES


def score(model: TrainedModel, df: DataFrame) -> DataFrame:
    """All input columns and ``predicted_{target}``; classes read as their labels.

    Map-only for pipeline models. Extra columns pass through; missing feature columns
    are an error.
    """
    df = tidy(df)
    absent = [c for c in model.features if c not in df.columns]
    if absent:
        raise ValueError(f"the data lacks feature columns {absent}")
    columns = [col(c) for c in df.columns if c != model.prediction_column]
    if model.known is None:
        out = model.pipeline.transform(df)
        guess = F.col(DECODED) if model.task_type == "classification" else F.col(PREDICTION)
        return out.select(*columns, guess.alias(model.prediction_column))
    numbered = with_row_id(df)
    shaped = model.pipeline.transform(numbered)
    queries = shaped.select(F.col(ROW_ID).alias("id"), vector_to_array(FEATURES).alias("vector"))
    guesses = predict_neighbours(model.known, queries, model.task_type, probes=model.settings.probes)
    guess = F.col("prediction")
    if model.task_type == "classification":
        guesses = named_classes(guesses, "prediction", "_named", model.classes, model.class_table)
        guess = F.col("_named")
    return (
        numbered.join(guesses.withColumnRenamed("query_id", ROW_ID), ROW_ID, "left")
        .select(*columns, guess.alias(model.prediction_column))
    )


def external_metrics(model: TrainedModel, scored: DataFrame) -> DataFrame | None:
    """Metrics where the scored table also holds the actual target, else None."""
    if model.target not in scored.columns:
        return None
    return evaluate_predictions(scored, model.target, model.prediction_column, model.task_type)


def external_confusion(model: TrainedModel, scored: DataFrame) -> DataFrame | None:
    """``actual, predicted, n`` of a classification whose table holds the actual target too,
    compared as text as in the metrics; else None."""
    if model.target not in scored.columns or model.task_type != "classification":
        return None
    df = tidy(scored)
    types = {f.name: f.dataType for f in df.schema.fields}
    return confusion_counts(df, *[category_text(c, types[c]) for c in (model.target, model.prediction_column)])


def preview(scored: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows in key order as text; missing and infinite values are empty."""
    types = {f.name: f.dataType for f in scored.schema.fields}
    head = scored.orderBy(*[F.asc(col(k)) for k in order_by]).limit(n)

    def shown(name: str):
        value = col(name)
        if kind_of(types[name]) == "nested":
            value = F.to_json(value)
        elif types[name].typeName() in ("double", "float"):
            value = F.when(F.abs(value) < float("inf"), value)
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return head.select(*[shown(c) for c in scored.columns])
