"""Registry tables on shared storage, for several writers at once.

Each table is a log of commits (``commits``): ids are given out by the commit that adds their
rows, and readers see whole appends.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators import registry
from tablewright.operators.quality import table_quality
from tablewright.sources.commits import CommitLog
from tablewright.sources.fingerprint import dataset_hash, file_hashes


class Catalogue:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas = {
            "datasets": registry.DATASET_SCHEMA, "experiments": registry.EXPERIMENT_SCHEMA,
            "model_log": registry.MODEL_LOG_SCHEMA, "stage_log": registry.STAGE_LOG_SCHEMA,
        }

    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/{name}", self._schemas[name])

    def table(self, name: str) -> DataFrame:
        return self._log(name).table()

    def register_dataset(self, path: str, original_filename: str, df: DataFrame | None) -> int:
        """Id of the files' content; a table that could not be read (None) is kept with an
        error mark."""
        content = dataset_hash(file_hashes(self.spark, path))
        known = registry.find_dataset(self.table("datasets"), content).first()
        if known:
            return known["id"]
        facts = table_quality(df).first() if df is not None else None
        row = (
            content, original_filename, path.rstrip("/").rsplit("/", 1)[-1], dt.datetime.now(),
            *((facts["rows"], facts["columns"], facts["missing_cells"], facts["duplicate_rows"]) if facts else (None,) * 4),
            path, None if facts else "the file could not be read",
        )
        incoming = self.spark.createDataFrame([row], registry.DATASET_SCHEMA.split(", ", 1)[1])
        self._log("datasets").append(lambda known: registry.new_datasets(known, incoming))
        return registry.find_dataset(self.table("datasets"), content).first()["id"]

    def log_experiment(
        self,
        dataset_id: int,
        algorithm: str,
        hyperparameters: Mapping[str, object] | None = None,
        metrics: Mapping[str, float] | None = None,
        model_id: str | None = None,
        tags: Sequence[str] = (),
        notes: str = "",
    ) -> int:
        row = (
            dt.datetime.now(), dataset_id, algorithm, {k: str(v) for k, v in (hyperparameters or {}).items()},
            [(k, None if v is None else float(v)) for k, v in (metrics or {}).items()], model_id, list(tags), notes,
        )
        incoming = self.spark.createDataFrame(
            [row],
            "timestamp timestamp, dataset_id bigint, algorithm string, hyperparameters map<string, string>, "
            "metrics array<struct<name: string, value: double>>, model_id string, tags array<string>, notes string",
        )
        datasets = self.table("datasets")
        _, added = self._log("experiments").append(lambda known: registry.new_experiments(datasets, known, incoming))
        return added.first()["id"]

    def register_model(self, model_id: str, metadata: Mapping[str, object]) -> None:
        texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in metadata.items()}
        log = registry.registration(self.spark, model_id, texts, dt.datetime.now())
        self._log("stage_log").append(lambda known: registry.first_versions(known, log).coalesce(1))
        self._log("model_log").append(lambda known: log)

    def transition(self, model_id: str, stage: str, version: str | None = None) -> None:
        now = dt.datetime.now()
        self._log("stage_log").append(lambda known: registry.transition(known, model_id, stage, now, version))

    def models(self, **filters) -> DataFrame:
        return registry.list_models(registry.current_models(self.table("model_log")), self.table("stage_log"), **filters)

    def experiments(self, dataset_id: int | None = None, limit: int = registry.LIST_LIMIT) -> DataFrame:
        return registry.list_experiments(self.table("experiments"), dataset_id, limit)

    def production(self) -> DataFrame:
        return registry.production_models(self.table("stage_log"))

    def lineage(self) -> DataFrame:
        return registry.lineage(
            registry.current_models(self.table("model_log")), self.table("experiments"), self.table("datasets")
        )

    def record_training(self, result, dataset_id: int | None = None) -> int | None:
        """Register a trained model and, for a known dataset, log the experiment."""
        about = result.model.metadata()
        if dataset_id is not None:
            about["dataset_id"] = str(dataset_id)
        self.register_model(result.model.model_id, about)
        if dataset_id is None:
            return None
        return self.log_experiment(
            dataset_id, result.model.algorithm, {"test_size": result.model.test_size}, result.model.metrics,
            result.model.model_id,
        )
