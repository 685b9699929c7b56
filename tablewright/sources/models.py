"""Trained models on shared storage: a pipeline directory and one metadata row."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tablewright.operators.models import Settings
from tablewright.operators.training import TrainedModel


def save_model(spark: SparkSession, model: TrainedModel, folder: str) -> str:
    """Write the model below ``folder`` under its id and return the path."""
    path = f"{folder.rstrip('/')}/{model.model_id}"
    model.pipeline.write().save(f"{path}/pipeline")
    if model.known is not None:
        model.known.write.parquet(f"{path}/known")
    if model.class_table is not None:
        model.class_table.write.parquet(f"{path}/classes")
    spark.createDataFrame([(json.dumps(model.metadata()),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    path = path.rstrip("/")
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    known = spark.read.parquet(f"{path}/known") if about["algorithm"] == "knn" else None
    listed = about["task_type"] != "classification" or about["classes"] is not None
    return TrainedModel(
        model_id=about["model_id"], algorithm=about["algorithm"], task_type=about["task_type"],
        target=about["target_column"], features=about["features_used"], numeric=about["numeric_features"],
        categorical=about["categorical_features"], classes=about["classes"], test_size=about["test_size"],
        pipeline=PipelineModel.load(f"{path}/pipeline"), known=known, metrics=about["metrics"],
        settings=Settings(**{k: v for k, v in about.get("settings", {}).items() if k in Settings.__dataclass_fields__}), class_table=None if listed else spark.read.parquet(f"{path}/classes"),
    )
