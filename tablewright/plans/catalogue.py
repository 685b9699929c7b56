"""Registry and report queries, over logs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.insights import dataset_facts, domain_insights
from tablewright.operators.leakage import leakage_findings, leakage_report
from tablewright.operators.profile import column_classes
from tablewright.operators.quality import table_quality
from tablewright.operators.registry import (
    DATASET_SCHEMA,
    EXPERIMENT_SCHEMA,
    current_models,
    current_stages,
    dataset_ids,
    experiments_of_model,
    first_versions,
    get_dataset,
    latest_versions,
    lineage,
    list_experiments,
    list_models,
    new_datasets,
    new_experiments,
    primary_metric,
    production_models,
)
from tablewright.operators.report import report_tables
from tablewright.operators.scoring import external_metrics, preview, score
from tablewright.operators.summary import categorical_summary, numeric_summary
from tablewright.operators.targets import recommend_targets
from tablewright.operators.training import compare_models, train
from tablewright.plans.registry import query, table


def _uploads(spark, folder):
    """Every document as an uploaded file; copies share a content hash."""
    return table(spark, folder, "documents").select(
        F.sha2("text", 256).alias("content_hash"),
        F.format_string("doc-%010d", "doc_id").alias("original_filename"),
        F.timestamp_seconds(F.col("doc_id")).alias("upload_time"),
        F.lit(1).cast("bigint").alias("rows"),
        F.col("n_chars").alias("columns"),
        "doc_id",
        "lang",
    )


_UPLOADS = """WITH u AS (SELECT sha256("text") AS h, doc_id, lang, n_chars FROM documents),
f AS (SELECT h, min(doc_id) AS first_doc FROM u WHERE lang = 'en' GROUP BY h),
a AS (SELECT h, row_number() OVER (ORDER BY first_doc, h) AS id FROM f),
g AS (SELECT h, min(doc_id) AS first_doc FROM u WHERE h NOT IN (SELECT h FROM a) GROUP BY h),
b AS (SELECT h, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY first_doc, h) AS id FROM g),
r AS (SELECT * FROM a UNION ALL SELECT * FROM b) """


@query(_UPLOADS + "SELECT u.doc_id, r.id AS dataset_id FROM u JOIN r ON r.h = u.h")
def registered_datasets(spark, folder):
    """English documents are registered first, then all of them."""
    uploads = _uploads(spark, folder)
    empty = spark.createDataFrame([], DATASET_SCHEMA)
    first = new_datasets(empty, uploads.filter(F.col("lang") == "en"))
    registry = first.unionByName(new_datasets(first, uploads))
    return dataset_ids(registry, uploads).select("doc_id", "dataset_id")


def _datasets(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("original_filename"),
        F.col("c_nationkey").cast("bigint").alias("rows"), F.lit(5).cast("bigint").alias("columns"),
    )


def _runs(spark, folder):
    """Every order as a training run on its customer's dataset."""
    number = F.col("o_totalprice")
    named = F.struct(F.lit("loss").alias("name"), number.alias("value"))
    best = F.struct(
        F.when(F.col("o_orderstatus") == "O", "r2_score").otherwise("accuracy").alias("name"), (number / 1000).alias("value")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").alias("dataset_id"),
        F.substring("o_orderpriority", 3, 20).alias("algorithm"),
        F.when(F.col("o_orderstatus") == "P", F.array(named)).otherwise(F.array(named, best)).alias("metrics"),
        F.format_string("model-%010d", "o_orderkey").alias("model_id"),
    )


@query(
    """SELECT row_number() OVER (ORDER BY o_orderdate, printf('model-%010d', o_orderkey)) AS id, printf('model-%010d', o_orderkey) AS model_id,
o_custkey AS dataset_id, c_name AS filename, CASE o_orderstatus WHEN 'P' THEN 'loss' WHEN 'O' THEN 'r2_score' ELSE 'accuracy' END AS metric,
CASE o_orderstatus WHEN 'P' THEN o_totalprice ELSE o_totalprice / 1000 END AS "value"
FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def experiment_log(spark, folder):
    empty = spark.createDataFrame([], EXPERIMENT_SCHEMA)
    logged = new_experiments(_datasets(spark, folder), empty, _runs(spark, folder))
    return logged.withColumn("best", primary_metric(F.col("metrics"))).select(
        "id", "model_id", "dataset_id", F.col("dataset_info.filename").alias("filename"),
        F.col("best.name").alias("metric"), F.col("best.value").alias("value"),
    )


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY o_orderdate, printf('model-%010d', o_orderkey)) AS id, o_orderdate, o_orderkey FROM orders)
SELECT id, printf('model-%010d', o_orderkey) AS model_id FROM e ORDER BY o_orderdate DESC, id DESC LIMIT 50"""
)
def newest_experiments(spark, folder):
    empty = spark.createDataFrame([], EXPERIMENT_SCHEMA)
    logged = new_experiments(_datasets(spark, folder), empty, _runs(spark, folder))
    return list_experiments(logged).select("id", "model_id")


def _model_log(spark, folder):
    """Every event as a registration of its user's model with one more fact."""
    return table(spark, folder, "events").select(
        F.format_string("model-%010d", "user_id").alias("model_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.create_map(
            F.lit("algorithm"), F.when(F.col("event_type") == "error", "ridge").otherwise("lasso"),
            F.lit("target_column"), F.col("event_type"),
            F.concat(F.lit("seen_"), F.col("event_type")), F.col("event_id").cast("string"),
        ).alias("metadata"),
    )


def _stage_log(spark, folder):
    """Every event as a stage transition of a version of its user's model."""
    stage = (
        F.when(F.col("event_type") == "signup", "development").when(F.col("event_type") == "purchase", "production")
        .when(F.col("event_type") == "error", "archived").otherwise("staging")
    )
    return table(spark, folder, "events").select(
        F.format_string("model-%010d", "user_id").alias("model_id"),
        F.concat(F.lit("1."), F.length("props").cast("string"), F.lit("."), F.floor(F.col("value")).cast("string")).alias("version"),
        stage.alias("stage"),
        F.col("ts").cast("timestamp").alias("at"),
    )


_STAGES = """WITH s AS (SELECT printf('model-%010d', user_id) AS model_id, '1.' || length(props) || '.' || floor("value")::BIGINT AS version,
[1, length(props), floor("value")::BIGINT] AS parts, ts,
CASE event_type WHEN 'signup' THEN 'development' WHEN 'purchase' THEN 'production' WHEN 'error' THEN 'archived' ELSE 'staging' END AS stage FROM events),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, version ORDER BY ts DESC, stage DESC) AS p FROM s) WHERE p = 1) """


@query(_STAGES + "SELECT model_id, version, stage FROM c")
def stages_now(spark, folder):
    return current_stages(_stage_log(spark, folder)).drop("since")


@query(
    _STAGES
    + """SELECT model_id, version FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY parts DESC) AS z FROM s) WHERE z = 1"""
)
def highest_versions(spark, folder):
    return latest_versions(_stage_log(spark, folder))


@query(
    _STAGES
    + """SELECT model_id, version FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY parts DESC) AS z
FROM c WHERE stage = 'production') WHERE z = 1"""
)
def in_production(spark, folder):
    return production_models(_stage_log(spark, folder))


@query(
    """WITH e AS (SELECT printf('model-%010d', user_id) AS model_id, * FROM events),
k AS (SELECT model_id, 'seen_' || event_type AS "key", event_id::VARCHAR AS "value", ts FROM e
UNION ALL SELECT model_id, 'algorithm', CASE WHEN event_type = 'error' THEN 'ridge' ELSE 'lasso' END, ts FROM e
UNION ALL SELECT model_id, 'target_column', event_type, ts FROM e)
SELECT model_id, "key", "value" FROM (SELECT *, row_number() OVER (PARTITION BY model_id, "key" ORDER BY ts DESC, "value" DESC) AS z FROM k) WHERE z = 1"""
)
def merged_models(spark, folder):
    return current_models(_model_log(spark, folder)).select("model_id", F.explode("metadata"))


@query(
    """WITH m AS (SELECT user_id, min(ts) AS born, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id)
SELECT printf('model-%010d', user_id) AS model_id FROM m WHERE last_type = 'error' ORDER BY born DESC, 1 LIMIT 50"""
)
def models_by_algorithm_and_stage(spark, folder):
    models = current_models(_model_log(spark, folder))
    return list_models(models, _stage_log(spark, folder), algorithm="ridge", stage="archived").select("model_id")


@query(
    _STAGES
    + """SELECT printf('model-%010d', user_id) AS model_id, '1.0.0' AS version, 'development' AS stage FROM events
WHERE printf('model-%010d', user_id) NOT IN (SELECT model_id FROM c WHERE stage = 'production') GROUP BY user_id"""
)
def first_stages(spark, folder):
    # the log at hand knows only models that have been in production
    log = _stage_log(spark, folder).where(F.col("stage") == "production")
    return first_versions(log, _model_log(spark, folder)).drop("at")


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY o_orderdate, printf('model-%010d', o_orderkey)) AS id, o_orderkey, o_custkey FROM orders)
SELECT printf('model-%010d', o_orderkey) AS model_id, id AS experiment_id, o_custkey AS dataset_id, c_name AS filename
FROM e LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT printf('unused-%010d', p_partkey), NULL, p_partkey, c_name FROM part LEFT JOIN customer ON c_custkey = p_partkey"""
)
def model_lineage(spark, folder):
    datasets = _datasets(spark, folder)
    runs = new_experiments(datasets, spark.createDataFrame([], EXPERIMENT_SCHEMA), _runs(spark, folder))
    trained = runs.select("model_id", F.create_map(F.lit("dataset_id"), F.lit(None).cast("string")).alias("metadata"))
    unused = table(spark, folder, "part").select(
        F.format_string("unused-%010d", "p_partkey").alias("model_id"),
        F.create_map(F.lit("dataset_id"), F.col("p_partkey").cast("string")).alias("metadata"),
    )
    return lineage(trained.unionByName(unused), runs, datasets)


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY o_orderdate, printf('model-%010d', o_orderkey)) AS id, o_orderkey FROM orders)
SELECT id, printf('model-%010d', o_orderkey) AS model_id FROM e WHERE o_orderkey = 7"""
)
def runs_of_model(spark, folder):
    runs = new_experiments(_datasets(spark, folder), spark.createDataFrame([], EXPERIMENT_SCHEMA), _runs(spark, folder))
    return experiments_of_model(runs, "model-0000000007").select("id", "model_id")


@query()
def report_frame(spark, folder):
    """All sections: facts, advice, a trained model, a comparison, leakage, scores and their metrics."""
    part = table(spark, folder, "part")
    quality, classes = table_quality(part), column_classes(part)
    numeric, categorical = numeric_summary(part), categorical_summary(part)
    findings = leakage_findings(part, "p_retailprice")
    trained = train(part, "p_retailprice", "ridge", key=["p_partkey"])
    scored = score(trained.model, part)
    return report_tables(
        quality, classes, dataset_facts(quality, classes), domain_insights("business", numeric, categorical, quality),
        recommend_targets(part), training=trained, leaderboard=compare_models(part, "p_retailprice", key=["p_partkey"]),
        leakage=leakage_report(part, "p_retailprice", findings), findings=findings,
        scored_preview=preview(scored, ["p_partkey"]), external=external_metrics(trained.model, scored), preview_order=["p_partkey"],
    )


@query(
    """WITH u AS (SELECT sha256("text") AS content_hash, doc_id FROM documents),
f AS (SELECT content_hash, min(doc_id) AS doc_id FROM u GROUP BY content_hash),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, content_hash) AS id FROM f)
SELECT id, content_hash, printf('doc-%010d', doc_id) AS original_filename FROM r WHERE id = 3"""
)
def registered_dataset(spark, folder):
    """One dataset by its id."""
    known = spark.createDataFrame([], DATASET_SCHEMA)
    return get_dataset(new_datasets(known, _uploads(spark, folder)), 3).select("id", "content_hash", "original_filename")
