"""How well predictions fit: confusion counts and error sums, nothing per row kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, category_text, col, tidy

def confusion_counts(
    df: DataFrame, actual: Column | str, predicted: Column | str, keep_missing: bool = False
) -> DataFrame:
    """``actual, predicted, n`` for the pairs that occur; those with a missing side only
    with ``keep_missing``."""
    a = actual if isinstance(actual, Column) else col(actual)
    p = predicted if isinstance(predicted, Column) else col(predicted)
    pairs = df.select(a.alias("actual"), p.alias("predicted"))
    if not keep_missing:
        pairs = pairs.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1; 0 for 0 / 0."""
    return _classification(counts, digits).drop("skipped")


def _classification(counts: DataFrame, digits: int | None) -> DataFrame:
    """The metrics and ``skipped``, the rows whose pair has a missing side, in one go."""
    none = F.lit(0).cast("bigint")
    whole = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    kept = F.when(whole, F.col("n")).otherwise(none)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(none)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"), kept.alias("support"), none.alias("chosen"), hit.alias("hits"),
                    (F.col("n") - kept).alias("skipped"),
                ),
                F.struct(
                    F.col("predicted").alias("label"), none.alias("support"), kept.alias("chosen"), none.alias("hits"),
                    none.alias("skipped"),
                ),
            )
        )
    )
    per_label = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits"), F.sum("skipped").alias("skipped"))
    precision = F.coalesce(F.try_divide("hits", "chosen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = per_label.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    total = F.sum("support")

    def weighted(value: Column) -> Column:
        return F.try_divide(F.sum(value * F.col("support")), total)

    out = scored.agg(
        total.alias("rows"),
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        weighted(F.col("precision")).alias("precision_weighted"),
        weighted(F.col("recall")).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
        F.coalesce(F.sum("skipped"), none).alias("skipped"),
    )
    return _rounded(out, digits)


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """``actual, predicted, n`` for every pair of labels that occur on either side: labels
    squared rows, for few labels. The counts themselves hold only the pairs that occur."""
    counts = counts.select(F.col("actual").cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted"), "n")
    seen = counts.agg(F.collect_set("actual").alias("a"), F.collect_set("predicted").alias("p"))
    grid = seen.select(F.array_union("a", "p").alias("labels")).select("labels", F.explode("labels").alias("actual")).select(
        "actual", F.explode("labels").alias("predicted")
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def regression_metrics(df: DataFrame, actual: Column | str, predicted: Column | str, digits: int | None = 4) -> DataFrame:
    """One row: rows, mae, rmse, r2_score. For a constant actual, R² is 1 if all is right
    and 0 otherwise; under two rows it is undefined."""
    return _regression(df, actual, predicted, digits).drop("skipped")


def _regression(df: DataFrame, actual: Column | str, predicted: Column | str, digits: int | None) -> DataFrame:
    """The metrics and ``skipped``, the rows where a side is no number, in one go."""
    a = actual if isinstance(actual, Column) else col(actual)
    p = predicted if isinstance(predicted, Column) else col(predicted)
    nothing = F.lit(None).cast("double")
    sides = df.select(F.nanvl(a.cast("double"), nothing).alias("a"), F.nanvl(p.cast("double"), nothing).alias("p"))
    pairs = sides.select(F.when(F.col("p").isNotNull(), F.col("a")).alias("y"), (F.col("a") - F.col("p")).alias("e"))
    sums = pairs.agg(
        F.count("y").alias("rows"),
        F.avg(F.abs("e")).alias("mae"),
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.var_pop("y").alias("spread"),
        (F.min("y") == F.max("y")).alias("constant"),
        F.count_if(F.col("y").isNull()).alias("skipped"),
    )
    r2 = (
        F.when(F.col("rows") < 2, F.lit(None).cast("double"))
        .when(F.col("constant") & (F.col("mse") == 0), 1.0)
        .when(F.col("constant"), 0.0)
        .otherwise(1 - F.try_divide("mse", "spread"))
    )
    return _rounded(sums.select("rows", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2_score"), "skipped"), digits)


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    counts = ("rows", "skipped")
    return df.select(*[c if c in counts else F.round(c, digits).alias(c) for c in df.columns])


def evaluate_predictions(df: DataFrame, actual: str, predicted: str, task_type: str) -> DataFrame:
    """Metrics of a scored table that holds the actual target.

    Classes are compared as text, with class 1 and class 1.0 as one; a regression leaves
    out pairs that are not numbers. ``skipped`` counts rows without an actual value or
    without a prediction; with no usable pair there is no row.
    """
    df = tidy(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    if task_type == "classification":
        a, p = category_text(actual, types[actual]), category_text(predicted, types[predicted])
        out = _classification(confusion_counts(df, a, p, keep_missing=True), 4)
    else:
        out = _regression(df, as_double(actual, types[actual]), as_double(predicted, types[predicted]), 4)
    return out.filter(F.coalesce(F.col("rows"), F.lit(0)) > 0)
