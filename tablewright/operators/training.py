"""Train one model, or compare several light ones on one split."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.layout import spread, working_copy
from tablewright.operators.blocks import check_width
from tablewright.operators.metrics import (
    classification_metrics,
    confusion_counts,
    regression_metrics,
)
from tablewright.operators.models import (
    FIDELITY,
    FULL,
    LIGHT,
    PREDICTION,
    Settings,
    check_algorithm,
    check_classes,
    feature_pipeline,
    fidelity_of,
    fit_model,
    importance_frame,
)
from tablewright.operators.dictionary import looked_up, size_of
from tablewright.operators.neighbours import average, nearest, vote
from tablewright.operators.prepare import FEATURES, LABEL, FeatureMap, Prepared, fit_features, prepare
from tablewright.operators.split import (
    IS_TEST,
    ROW_ID,
    assign_split,
    sample_rows,
    with_row_id,
)
from tablewright.session import ensure_checkpoint_dir
from tablewright.sources.tables import require_rows

SMALL_ROWS = 100
BASELINE_ROWS = 200
NEIGHBOURS = 5
DECODED = "_decoded"

LIGHT_ALGORITHMS = {
    "classification": ["logistic_regression", "decision_tree", "random_forest", "extra_trees"],
    "regression": ["linear_regression", "ridge", "decision_tree", "random_forest", "extra_trees"],
}
RANKING = {"classification": "f1_weighted", "regression": "r2_score"}


@dataclass
class TrainedModel:
    """A fitted model with all that scoring needs."""

    model_id: str
    algorithm: str
    task_type: str
    target: str
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    classes: list[str] | None
    test_size: float
    pipeline: PipelineModel
    known: DataFrame | None = None  # rows of a nearest-neighbour model
    metrics: dict = field(default_factory=dict)
    settings: Settings = FULL
    class_table: DataFrame | None = None  # ``class, label`` of classes too many to list

    @property
    def prediction_column(self) -> str:
        return f"predicted_{self.target}"

    def metadata(self) -> dict:
        return {
            "model_id": self.model_id, "algorithm": self.algorithm, "task_type": self.task_type,
            "target_column": self.target, "features_used": self.features, "numeric_features": self.numeric,
            "categorical_features": self.categorical, "classes": self.classes, "test_size": self.test_size,
            "fidelity": fidelity_of(self.algorithm, self.settings), "metrics": self.metrics, "settings": asdict(self.settings),
        }


@dataclass
class TrainingResult:
    model: TrainedModel
    rows: int
    train_rows: int
    test_rows: int
    dropped: list[str]
    metrics: DataFrame
    confusion: DataFrame | None
    importance: DataFrame
    recommendation: DataFrame
    explanation: DataFrame
    warnings: list[str]


def new_model_id(algorithm: str, target: str) -> str:
    name = f"{algorithm}_{target}_{uuid.uuid4().hex[:8]}"
    return name.replace(" ", "_").replace("/", "_").replace("\\", "_")


@contextmanager
def _fixed_rows(prepared: Prepared, number: bool = False) -> Iterator[None]:
    """Within the block, ``prepared.frame`` holds only columns the model needs, and a key.

    Without a key of their own, or with ``number``, rows are written out once with a
    fixed id.
    """
    columns = dict.fromkeys([*prepared.numeric, *prepared.categorical, LABEL, *(prepared.key or [])])
    frame = prepared.frame.select(*map(col, columns))
    if number or not prepared.key:
        prepared.frame = with_row_id(spread(frame, prepared.rows))
        prepared.key = prepared.key or [ROW_ID]
        yield
        return
    with working_copy(frame, prepared.rows) as copy:
        prepared.frame = copy
        yield


def _split(prepared: Prepared, test_size: float) -> tuple[DataFrame, DataFrame]:
    label = LABEL if prepared.class_count else None
    marked = assign_split(prepared.frame, test_size, prepared.key, label, max(prepared.class_count, 1))
    return marked.filter(~F.col(IS_TEST)).drop(IS_TEST), marked.filter(F.col(IS_TEST)).drop(IS_TEST)


def _vectors(features: FeatureMap, frame: DataFrame, label: bool) -> DataFrame:
    """``id, vector`` and, of known rows, ``label``, as the neighbour search reads them."""
    shaped = features.model.transform(frame)
    columns = [F.col(ROW_ID).alias("id"), vector_to_array(FEATURES).alias("vector")]
    return shaped.select(*columns, *([F.col(LABEL).alias("label")] if label else []))


def predict_neighbours(
    known: DataFrame, queries: DataFrame, task_type: str, k: int = NEIGHBOURS, probes: int | None = None
) -> DataFrame:
    found = nearest(known, queries, k, probes=probes)
    return vote(found) if task_type == "classification" else average(found)


def train(
    df: DataFrame,
    target: str,
    algorithm: str,
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    settings: Settings = FULL,
    distinct: str = "auto",
) -> TrainingResult:
    """Prepare, split, fit, predict the test part and measure.

    ``key`` names columns that identify a row. With it the split depends on the data
    alone; without it rows are numbered once in the checkpoint folder.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    prepared = prepare(require_rows(df), target, key, distinct)
    name = check_algorithm(prepared.task_type, algorithm)
    check_classes(name, prepared.class_count)
    with _fixed_rows(prepared, number=name == "knn"):
        train_part, test_part = _split(prepared, test_size)
        features = fit_features(train_part, prepared.numeric, prepared.categorical)
        known, importances = None, None
        if name == "knn":
            check_width(features.width, "a nearest-neighbour model")
            known = _vectors(features, train_part, True)
            pipeline = features.model
            guesses = predict_neighbours(known, _vectors(features, test_part, False), prepared.task_type, probes=settings.probes)
            scored = test_part.select(F.col(ROW_ID).alias("query_id"), LABEL).join(guesses, "query_id")
            scored = scored.withColumnRenamed("prediction", PREDICTION)
        else:
            ensure_checkpoint_dir(df.sparkSession)
            shaped = features.model.transform(train_part)
            fitted = fit_model(name, prepared.task_type, shaped, features, prepared.class_count, settings)
            importances = fitted.importances
            decode = []
            if prepared.classes:
                decode = [IndexToString(inputCol=PREDICTION, outputCol=DECODED, labels=prepared.classes)]
            pipeline = feature_pipeline(features, fitted, decode)
            scored = pipeline.transform(test_part)
        scored = scored.select(LABEL, PREDICTION).persist()
        try:
            metrics, confusion, row = _measure(scored, prepared)
            test_rows = scored.count()
        finally:
            scored.unpersist()
    model = TrainedModel(
        model_id=new_model_id(name, prepared.target), algorithm=name, task_type=prepared.task_type,
        target=prepared.target, features=prepared.features, numeric=prepared.numeric,
        categorical=prepared.categorical, classes=prepared.classes, test_size=test_size, pipeline=pipeline,
        known=known, metrics=row, settings=settings, class_table=prepared.class_table,
    )
    warnings = ["The data set is small; metrics may be unreliable."] if prepared.rows < SMALL_ROWS else []
    spark = df.sparkSession
    return TrainingResult(
        model=model, rows=prepared.rows, train_rows=prepared.rows - test_rows, test_rows=test_rows,
        dropped=prepared.dropped, metrics=metrics, confusion=confusion,
        importance=importance_frame(spark, features, importances),
        recommendation=recommend_model(
            spark, prepared.task_type, prepared.rows, bool(prepared.numeric), bool(prepared.categorical)
        ),
        explanation=explain_model(metrics, prepared.task_type, name),
        warnings=warnings,
    )


def named_classes(df: DataFrame, label: str, name: str, classes: list[str] | None, class_table: DataFrame | None) -> DataFrame:
    """``df`` with the class of each label as column ``name``."""
    if classes is not None:
        return IndexToString(inputCol=label, outputCol=name, labels=classes).transform(df)
    names = class_table.select(F.col("label").alias("_class_label"), F.col("class").alias(name))
    return looked_up(df, names, size_of(class_table, "class").small, label, "_class_label")


def _measure(scored: DataFrame, prepared: Prepared) -> tuple[DataFrame, DataFrame | None, dict]:
    """Metrics as a frame detached from the scoring, the confusion counts (of the pairs that
    occur), and the values."""
    spark = scored.sparkSession
    if prepared.class_count:
        ensure_checkpoint_dir(spark)
        counts = confusion_counts(scored, LABEL, PREDICTION).checkpoint()
        metrics = classification_metrics(counts)
        decoded = counts
        for side in ("actual", "predicted"):
            decoded = named_classes(decoded, side, f"_{side}", prepared.classes, prepared.class_table)
        confusion = decoded.select(F.col("_actual").alias("actual"), F.col("_predicted").alias("predicted"), "n")
    else:
        metrics, confusion = regression_metrics(scored, LABEL, PREDICTION), None
    row = metrics.first()
    values = {k: v for k, v in row.asDict().items() if k != "rows"}
    return spark.createDataFrame([row], metrics.schema), confusion, values


def compare_models(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    max_rows: int | None = None,
    settings: Settings = LIGHT,
    distinct: str = "auto",
) -> DataFrame:
    """``rank, algorithm, score, fidelity, error, rows, train_rows, test_rows, metrics``: light
    models on one split, best first, failed ones last.

    All rows are compared on. ``max_rows`` bounds the rows that classifiers are fitted on, a
    sample of the training part by key hash; every test row is scored in any case.
    """
    prepared = prepare(require_rows(df), target, key, distinct)
    with _fixed_rows(prepared):
        return _compare(prepared, test_size, max_rows, settings)


def _compare(prepared: Prepared, test_size: float, max_rows: int | None, settings: Settings) -> DataFrame:
    spark = prepared.frame.sparkSession
    train_part, test_part = _split(prepared, test_size)
    if max_rows is not None and prepared.class_count and prepared.rows > max_rows:
        train_part = sample_rows(train_part, max_rows, prepared.key)
    features = fit_features(train_part, prepared.numeric, prepared.categorical)
    ensure_checkpoint_dir(spark)
    # one shaped copy serves every model
    shaped, test_shaped = (features.model.transform(part).select(LABEL, FEATURES).persist() for part in (train_part, test_part))
    measure = RANKING[prepared.task_type]

    def compared(name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            check_classes(name, prepared.class_count)
            fitted = fit_model(name, prepared.task_type, shaped, features, prepared.class_count, settings)
            scored = PipelineModel(stages=fitted.stages).transform(test_shaped).select(LABEL, PREDICTION)
            _, _, values = _measure(scored, prepared)
            return values[measure], FIDELITY[name], None, values
        except Exception as error:  # one failed family does not end the comparison
            return None, FIDELITY[name], str(error)[:500], {}

    names = LIGHT_ALGORITHMS[prepared.task_type]
    try:
        sizes = (shaped.count(), test_shaped.count())
        # families share the cluster: while one waits for a step's result, others have tasks to run
        with ThreadPoolExecutor(len(names)) as pool:
            futures = [pool.submit(inheritable_thread_target(spark)(compared), name) for name in names]
            rows = [(place, name, *future.result()) for place, (name, future) in enumerate(zip(names, futures))]
    finally:
        shaped.unpersist()
        test_shaped.unpersist()
    rows.sort(key=lambda r: (r[2] is None, -(r[2] if r[2] is not None else 0.0), r[0]))
    total = prepared.rows
    return spark.createDataFrame(
        [(i + 1, n, s, f, e, total, *sizes, m) for i, (_, n, s, f, e, m) in enumerate(rows)],
        "rank int, algorithm string, score double, fidelity string, error string, rows bigint, "
        "train_rows bigint, test_rows bigint, metrics map<string,double>",
    )


def comparison_result(board: DataFrame, task_type: str) -> DataFrame:
    """One row about a leaderboard: ``best`` algorithm, ``ranked_by`` which measure, its
    ``score``, and ``warnings`` (families that failed, a small table)."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat(F.lit("failed="), "algorithm"))))
    small = F.when(F.max("rows") < SMALL_ROWS, F.array(F.lit(f"rows<{SMALL_ROWS}"))).otherwise(F.array().cast("array<string>"))
    return board.agg(
        F.max(F.when((F.col("rank") == 1) & F.col("score").isNotNull(), F.col("algorithm"))).alias("best"),
        F.lit(RANKING[task_type]).alias("ranked_by"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.concat(failed, small).alias("warnings"),
    )


def recommend_model(spark, task_type: str, rows: int, has_numeric: bool, has_categorical: bool) -> DataFrame:
    """One row: ``recommended, reasons``; a plain baseline under 200 rows, a forest above."""
    few = F.col("rows") < BASELINE_ROWS
    baseline = "logistic_regression" if task_type == "classification" else "ridge"
    return spark.range(1).select(F.lit(rows).alias("rows")).select(
        F.when(few, baseline).otherwise("random_forest").alias("recommended"),
        F.array_compact(
            F.array(
                F.concat_ws("", F.lit("rows"), F.when(few, "<").otherwise(">="), F.lit(BASELINE_ROWS)),
                F.lit("categorical_features" if has_categorical else None),
                F.lit("numeric_features" if has_numeric else None),
            )
        ).alias("reasons"),
    )


# Least measure of each band.
BANDS = {"classification": ("f1_weighted", 0.85, 0.65), "regression": ("r2_score", 0.8, 0.5)}


def explain_model(metrics: DataFrame, task_type: str, algorithm: str) -> DataFrame:
    """``position, statement`` from a metrics row: algorithm, its two main measures, and the
    band (strong, moderate, weak) in which the deciding one lies."""
    measure, strong, moderate = BANDS[task_type]
    shown = ("accuracy", "f1_weighted") if task_type == "classification" else ("r2_score", "rmse")
    figures = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in shown])
    band = F.when(F.col(measure) >= strong, "strong").when(F.col(measure) >= moderate, "moderate").when(F.col(measure).isNotNull(), "weak")
    return metrics.select(
        F.posexplode(F.array_compact(F.array(F.lit(f"algorithm={algorithm}"), figures, F.concat(F.lit("band="), band)))).alias(
            "position", "statement"
        )
    )
