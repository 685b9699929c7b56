"""Datasets, experiments and models as tables that are only ever appended to.

Every function takes and returns DataFrames; what is current is derived from the log by
aggregates, so a key that holds a third of all rows is folded before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.columns import col
from tablewright.session import ensure_checkpoint_dir

DATASET_SCHEMA = (
    "id bigint, content_hash string, original_filename string, stored_filename string, upload_time timestamp, "
    "rows bigint, columns bigint, missing_cells bigint, duplicate_rows bigint, file_path string, error string"
)
EXPERIMENT_SCHEMA = (
    "id bigint, timestamp timestamp, dataset_id bigint, "
    "dataset_info struct<filename: string, rows: bigint, columns: bigint>, algorithm string, "
    "hyperparameters map<string, string>, metrics array<struct<name: string, value: double>>, "
    "model_id string, tags array<string>, notes string"
)
MODEL_LOG_SCHEMA = "model_id string, at timestamp, metadata map<string, string>"
STAGE_LOG_SCHEMA = "model_id string, version string, stage string, at timestamp"

STAGES = ["development", "staging", "production", "archived"]
FIRST_VERSION = "1.0.0"
LIST_LIMIT = 50

# The metrics that stand for an experiment.
PRIMARY_METRICS = ["accuracy", "f1_weighted", "r2_score"]


def assign_ids(df: DataFrame, start: int, order_by: Sequence[str]) -> DataFrame:
    """Adds ``id``: start, start + 1, ... in key order.

    The rows are sorted over all tasks and written out once; an id is then the number
    of rows in earlier partitions plus the place within its own.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    laid_out = (
        df.orderBy(*[F.asc(col(k)) for k in order_by])
        .withColumn("_part", F.shiftright(place, 33))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    return (
        laid_out.join(F.broadcast(offsets), "_part")
        .withColumn("id", F.col("_offset") + F.col("_place") + F.lit(start))
        .drop("_part", "_place", "_offset")
    )


def _next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


# -- datasets -----------------------------------------------------------------------


def new_datasets(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: incoming content not registered before, once per content hash,
    numbered in upload order. ``incoming`` has the registry's columns but ``id``."""
    names = [c for c in incoming.columns if c != "content_hash"]
    order = F.struct("upload_time", "original_filename")
    first = incoming.groupBy("content_hash").agg(F.min_by(F.struct(*map(col, names)), order).alias("row"))
    fresh = first.join(registry.select("content_hash"), "content_hash", "left_anti").select("content_hash", "row.*")
    numbered = assign_ids(fresh, _next_id(registry), ["upload_time", "content_hash"])
    return _shaped(numbered, DATASET_SCHEMA)


def dataset_ids(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with the id their content is registered under."""
    return incoming.join(registry.select("content_hash", F.col("id").alias("dataset_id")), "content_hash", "left")


def get_dataset(registry: DataFrame, dataset_id: int) -> DataFrame:
    return registry.filter(F.col("id") == dataset_id)


def find_dataset(registry: DataFrame, content_hash: str) -> DataFrame:
    return registry.filter(F.col("content_hash") == content_hash)


def list_datasets(registry: DataFrame) -> DataFrame:
    return registry.orderBy("id")


# -- experiments --------------------------------------------------------------------


def new_experiments(datasets: DataFrame, experiments: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append, numbered in time order, with the dataset's name and size copied.
    An unknown dataset is an error."""
    unknown = incoming.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"dataset {unknown[0]['dataset_id']} is not registered")
    info = datasets.select(
        F.col("id").alias("dataset_id"),
        F.struct(F.col("original_filename").alias("filename"), "rows", "columns").alias("dataset_info"),
    )
    joined = incoming.join(info, "dataset_id")
    order = [c for c in ("timestamp", "model_id", "dataset_id") if c in joined.columns]
    return _shaped(assign_ids(joined, _next_id(experiments), order), EXPERIMENT_SCHEMA)


def get_experiment(experiments: DataFrame, experiment_id: int) -> DataFrame:
    return experiments.filter(F.col("id") == experiment_id)


def list_experiments(experiments: DataFrame, dataset_id: int | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest first."""
    if dataset_id is not None:
        experiments = experiments.filter(F.col("dataset_id") == dataset_id)
    return experiments.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def experiments_of_model(experiments: DataFrame, model_id: str) -> DataFrame:
    return experiments.filter(F.col("model_id") == model_id)


def primary_metric(metrics: Column) -> Column:
    """``struct<name, value>``: the first of the usual metrics, else the first of all."""
    usual = F.filter(metrics, lambda m: m["name"].isin(PRIMARY_METRICS))
    return F.coalesce(F.get(usual, F.lit(0)), F.get(metrics, F.lit(0)))


# -- models -------------------------------------------------------------------------


def registration(spark, model_id: str, metadata: Mapping[str, str], at) -> DataFrame:
    """The log row of one registration. Registering again adds to the metadata."""
    return spark.createDataFrame([(model_id, at, {**metadata, "model_id": model_id})], MODEL_LOG_SCHEMA)


def first_versions(stage_log: DataFrame, model_log: DataFrame) -> DataFrame:
    """Stage rows to append for models that have none: version 1.0.0 in development."""
    seen = stage_log.select("model_id").distinct()
    fresh = model_log.groupBy("model_id").agg(F.min("at").alias("at")).join(seen, "model_id", "left_anti")
    return fresh.select("model_id", F.lit(FIRST_VERSION).alias("version"), F.lit("development").alias("stage"), "at")


def current_models(model_log: DataFrame) -> DataFrame:
    """``model_id, registered_at, updated_at, metadata``: all registrations of a model
    merged, the newest value of each metadata key winning."""
    times = model_log.groupBy("model_id").agg(F.min("at").alias("registered_at"), F.max("at").alias("updated_at"))
    entries = model_log.select("model_id", "at", F.explode("metadata"))
    newest = entries.groupBy("model_id", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    merged = newest.groupBy("model_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata")
    )
    return times.join(merged, "model_id", "left")


def get_model(models: DataFrame, model_id: str) -> DataFrame:
    return models.filter(F.col("model_id") == model_id)


def list_models(
    models: DataFrame,
    stage_log: DataFrame | None = None,
    algorithm: str | None = None,
    target: str | None = None,
    stage: str | None = None,
    limit: int = LIST_LIMIT,
) -> DataFrame:
    """Models with matching metadata and current stage, newest first."""
    if algorithm is not None:
        models = models.filter(F.col("metadata")["algorithm"] == algorithm)
    if target is not None:
        models = models.filter(F.col("metadata")["target_column"] == target)
    if stage is not None:
        if stage_log is None:
            raise ValueError("filtering by stage needs the stage log")
        last = stage_log.groupBy("model_id").agg(F.max_by("stage", F.struct("at", "version")).alias("stage"))
        models = models.join(last.filter(F.col("stage") == stage).select("model_id"), "model_id", "left_semi")
    return models.orderBy(F.desc("registered_at"), F.asc("model_id")).limit(limit)


def version_order(version: Column) -> Column:
    """Numeric parts of a version, so that 1.10.0 follows 1.9.0; others rank as 0.0.0."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.array(*[F.lit(0)] * 3)).otherwise(parts)


def current_stages(stage_log: DataFrame) -> DataFrame:
    """``model_id, version, stage, since``: the latest stage of every version."""
    latest = stage_log.groupBy("model_id", "version").agg(F.max(F.struct("at", "stage")).alias("last"))
    return latest.select("model_id", "version", F.col("last.stage").alias("stage"), F.col("last.at").alias("since"))


def latest_versions(stage_log: DataFrame) -> DataFrame:
    """``model_id, version``: the highest version of every model."""
    return stage_log.groupBy("model_id").agg(
        F.max_by("version", F.struct(version_order(F.col("version")), "version")).alias("version")
    )


def transition(stage_log: DataFrame, model_id: str, stage: str, at, version: str | None = None) -> DataFrame:
    """The row that moves a version, by default the highest, to a stage. A version not
    seen before is added."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; choose from {STAGES}")
    mine = stage_log.filter(F.col("model_id") == model_id)
    if version is None:
        highest = latest_versions(mine).first()
        if highest is None:
            raise ValueError(f"model {model_id!r} is not registered")
        version = highest["version"]
    elif mine.isEmpty():
        raise ValueError(f"model {model_id!r} is not registered")
    return stage_log.sparkSession.createDataFrame([(model_id, version, stage, at)], STAGE_LOG_SCHEMA)


def production_models(stage_log: DataFrame) -> DataFrame:
    """``model_id, version``: the highest version in production of each model that has one."""
    return latest_versions(current_stages(stage_log).filter(F.col("stage") == "production"))


def lineage(models: DataFrame, experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """``model_id, experiment_id, dataset_id, filename``: one row per experiment behind a
    model; models without any keep one row, with the dataset of their metadata."""
    runs = experiments.select("model_id", F.col("id").alias("experiment_id"), F.col("dataset_id").alias("run_dataset"))
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("original_filename").alias("filename"))
    noted = F.col("metadata")["dataset_id"].try_cast("bigint")
    noted_models = models.select("model_id", noted.alias("noted"))
    # an inner join, whose hot keys Spark can split on either side, and the rest apart
    with_runs = noted_models.join(runs, "model_id").select(
        "model_id", "experiment_id", F.coalesce("run_dataset", "noted").alias("dataset_id")
    )
    without = noted_models.join(runs.select("model_id").distinct(), "model_id", "left_anti").select(
        "model_id", F.lit(None).cast("bigint").alias("experiment_id"), F.col("noted").alias("dataset_id")
    )
    # dealt out anew: frames that are both laid out by id are united task by task, and a task
    # would hold the sorted rows of both joins
    without = without.hint("rebalance")
    return with_runs.unionByName(without).join(named, "dataset_id", "left").select(
        "model_id", "experiment_id", "dataset_id", "filename"
    )


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order, typed; those the frame lacks are NULL."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[
            (col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
