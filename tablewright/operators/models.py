"""Model families by name, as Spark ML estimators.

``fidelity`` says how a family relates to its definition: ``exact`` objective,
``binned`` splits, or ``approximate`` where Spark has no such learner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.binned_forest import fit_binned_forest
from tablewright.operators.kernel import KernelMachine, fit_machine
from tablewright.operators.prepare import FEATURES, HELD_CLASSES, LABEL, FeatureMap
from tablewright.operators.row_trees import fit_random_trees

PREDICTION = "_prediction"
SEED = 42
TREES = 120
FAST_TREES = 40
DEEPEST = 30  # Spark's limit; a full tree elsewhere
PROBABILITY = "_probability"

ALGORITHMS = {
    "classification": ["logistic_regression", "random_forest", "extra_trees", "decision_tree", "knn", "svm"],
    "regression": ["linear_regression", "ridge", "lasso", "random_forest", "extra_trees", "decision_tree", "knn", "svm"],
}

FIDELITY = {
    "logistic_regression": "exact", "linear_regression": "exact", "ridge": "exact", "lasso": "exact", "knn": "exact",
    "decision_tree": "binned", "random_forest": "binned", "extra_trees": "exact", "svm": "approximate",
}


def check_algorithm(task_type: str, algorithm: str) -> str:
    if task_type not in ALGORITHMS:
        raise ValueError(f"unknown task {task_type!r}")
    name = algorithm.lower().strip()
    if name not in ALGORITHMS[task_type]:
        raise ValueError(f"no {task_type} algorithm {algorithm!r}; choose from {ALGORITHMS[task_type]}")
    return name


@dataclass(frozen=True)
class Settings:
    """What the full and the light variants of a family differ in; the same at every size of
    the data. Trees live on the driver, so very large data may call for a smaller depth."""

    trees: int = TREES
    depth: int = DEEPEST
    forest_depth: int = DEEPEST
    iterations: int = 1000
    components: int = 256  # landmarks of a kernel machine
    probes: int | None = None  # centres around which neighbours are searched; all that can matter if unset


FULL = Settings()
LIGHT = Settings(trees=FAST_TREES, depth=8, forest_depth=10, iterations=500)


@dataclass
class Fitted:
    """Stages behind the feature vector, and importance per feature where a family has it."""

    stages: list[Transformer]
    importances: list[float] | None = None


def check_classes(algorithm: str, classes: int) -> None:
    """Families that keep numbers per class are refused before any work where there are too many."""
    if algorithm != "knn" and classes > HELD_CLASSES:
        raise ValueError(f"{algorithm} keeps numbers for each class, up to {HELD_CLASSES}, and there are {classes}; knn has no such limit")


def fidelity_of(algorithm: str, settings: Settings) -> str:
    return "approximate" if algorithm == "knn" and settings.probes else FIDELITY[algorithm]


def fit_model(
    algorithm: str, task_type: str, train: DataFrame, features: FeatureMap, classes: int, settings: Settings = FULL
) -> Fitted:
    """Fit one family on a frame that holds the feature vector and the label."""
    name = check_algorithm(task_type, algorithm)
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    if name == "knn":
        raise ValueError("knn keeps its rows as the model; see the neighbours operators")
    if name in ("logistic_regression", "linear_regression", "ridge", "lasso"):
        return Fitted([_linear(name, train, common, settings)])
    if name == "svm":
        machine = fit_machine(train, FEATURES, LABEL, classes, settings.components, SEED)
        return Fitted([KernelMachine(FEATURES, PREDICTION, PROBABILITY, classes, machine)])
    if name == "extra_trees":
        forest, importances = fit_random_trees(
            train, FEATURES, LABEL, PREDICTION, features.width, classes, settings.trees, settings.forest_depth, SEED,
            features.groups,
        )
        return Fitted([forest], importances)
    if name == "random_forest" and task_type == "regression":
        counted = fit_binned_forest(
            train, FEATURES, LABEL, PREDICTION, features.width, settings.trees, settings.forest_depth, SEED, features.groups,
        )
        if counted is not None:
            return Fitted([counted[0]], counted[1])
    growth = _growth()
    if name == "decision_tree":
        family = DecisionTreeClassifier if task_type == "classification" else DecisionTreeRegressor
        model = family(maxDepth=settings.depth, maxBins=64, seed=SEED, **growth, **common).fit(train)
    elif task_type == "classification":
        model = RandomForestClassifier(
            numTrees=settings.trees, maxDepth=settings.forest_depth, featureSubsetStrategy="sqrt", seed=SEED, **growth, **common,
        ).fit(train)
    else:
        model = RandomForestRegressor(
            numTrees=settings.trees, maxDepth=settings.forest_depth, featureSubsetStrategy="all", seed=SEED, **growth, **common,
        ).fit(train)
    return Fitted([model], _importances(model))


def _growth() -> dict:
    """Node ids kept per row: without them every round sends all trees to all tasks and
    walks each row down from the roots, which is most of the time of deep forests."""
    return {"maxMemoryInMB": 1024, "cacheNodeIds": True, "checkpointInterval": 10}


def _importances(model: Model) -> list[float]:
    return [float(v) for v in model.featureImportances.toArray()]


def _linear(name: str, train: DataFrame, common: dict, settings: Settings) -> Model:
    size = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("spread")).first()
    if name == "logistic_regression":
        # the same objective divided by C n
        return LogisticRegression(
            regParam=1.0 / size["n"], elasticNetParam=0.0, standardization=False, maxIter=settings.iterations,
            probabilityCol=PROBABILITY, rawPredictionCol="_raw", **common,
        ).fit(train)
    spread = size["spread"] or 1.0
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, **common).fit(train)
    if name == "ridge":
        # Spark penalises coefficients of the label scaled by its deviation
        return LinearRegression(
            regParam=1.0 * spread / size["n"], elasticNetParam=0.0, standardization=False, **common
        ).fit(train)
    return LinearRegression(
        regParam=0.01, elasticNetParam=1.0, standardization=False, maxIter=5000, tol=1e-8, **common
    ).fit(train)


def importance_frame(spark, features: FeatureMap, importances: Sequence[float] | None, top: int = 12) -> DataFrame:
    """``rank, feature, importance`` of the most important features; none for families
    without importances."""
    best = sorted(((round(v, 4), -i) for i, v in enumerate(importances or [])), reverse=True)[:top]
    names = features.names_of(spark, [-i for _, i in best])
    return spark.createDataFrame(
        [(r + 1, names[-i], v) for r, (v, i) in enumerate(best)], "rank int, feature string, importance double"
    )


def feature_pipeline(features: FeatureMap, fitted: Fitted, extra: Sequence[Transformer] = ()) -> PipelineModel:
    return PipelineModel(stages=[*features.stages, *fitted.stages, *extra])
