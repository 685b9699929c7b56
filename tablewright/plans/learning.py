"""Preparation, model, evaluation and scoring queries."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators.metrics import (
    classification_metrics,
    confusion_counts,
    confusion_matrix,
    evaluate_predictions,
    regression_metrics,
)
from tablewright.operators.models import fit_model
from tablewright.operators.neighbours import average, nearest, vote
from tablewright.operators.prepare import (
    FEATURES,
    LABEL,
    fit_categories,
    fit_features,
    fit_numeric,
    prepare,
)
from tablewright.operators.scoring import external_confusion, external_metrics, preview, score
from tablewright.operators.split import IS_TEST, assign_split
from tablewright.operators.training import compare_models, comparison_result, explain_model, recommend_model, train
from tablewright.plans.registry import LABELLED, facts_sql, labelled_documents, query, table
from tablewright.session import remove_at_end, shared_folder
from tablewright.sources.models import load_model, save_model

# -- preparation --------------------------------------------------------------------


@query(
    f"""WITH f AS ({facts_sql('customer')})
SELECT "column", CASE WHEN kind = 'string' AND dist / n > 0.95 THEN 'dropped' WHEN kind = 'numeric' THEN 'numeric' ELSE 'categorical' END AS role,
'classification' AS task, n AS "rows" FROM f WHERE "column" <> 'c_mktsegment'"""
)
def feature_roles(spark, folder):
    done = prepare(table(spark, folder, "customer"), "c_mktsegment", ["c_custkey"])
    roles = [(c, "dropped") for c in done.dropped] + [(c, "numeric") for c in done.numeric]
    roles += [(c, "categorical") for c in done.categorical]
    return spark.createDataFrame([(c, r, done.task_type, done.rows) for c, r in roles], "column string, role string, task string, rows bigint")


@query(
    """SELECT c_mktsegment AS class, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code, count(*) AS n
FROM customer GROUP BY c_mktsegment"""
)
def class_codes(spark, folder):
    done = prepare(table(spark, folder, "customer"), "c_mktsegment", ["c_custkey"])
    return done.frame.groupBy(F.col("c_mktsegment").alias("class"), F.col(LABEL).alias("code")).agg(F.count("*").alias("n"))


_QUOTAS = """WITH c AS (SELECT {label} AS k, count(*) AS n FROM {table} GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n) - ceil(sum(n) * 0.2) AS train FROM c),
i AS (SELECT k, n, n * train / total AS ideal, floor(n * train / total) AS base, train FROM c CROSS JOIN t),
r AS (SELECT *, row_number() OVER (ORDER BY base - ideal, k) AS place, train - sum(base) OVER () AS spare FROM i)
SELECT k AS "class", n AS "rows", (n - base - CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM r"""


@query(_QUOTAS.format(label="c_mktsegment", table="customer"))
def stratified_split(spark, folder):
    done = prepare(table(spark, folder, "customer"), "c_mktsegment", ["c_custkey"])
    marked = assign_split(done.frame, 0.2, ["c_custkey"], LABEL, len(done.classes))
    return marked.groupBy(F.col("c_mktsegment").alias("class")).agg(
        F.count("*").alias("rows"), F.count_if(F.col(IS_TEST)).alias("test_rows")
    )


@query("SELECT count(*) AS \"rows\", ceil(count(*) * 0.2)::BIGINT AS test_rows FROM lineitem")
def plain_split(spark, folder):
    items = table(spark, folder, "lineitem")
    marked = assign_split(
        items, 0.2, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    )
    return marked.agg(F.count("*").alias("rows"), F.count_if(F.col(IS_TEST)).alias("test_rows"))


def _fit_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(m, 4) AS median, round(avg(coalesce({c}, m)), 4) AS mean, round(stddev_pop(coalesce({c}, m)), 4) AS scale
FROM {LABELLED} AS src, (SELECT median({c})::DOUBLE AS m FROM {LABELLED} AS s2) GROUP BY m"""
        for c in columns
    )


@query(_fit_sql(["n_chars", "quality", "toxic"]))
def fill_and_scale(spark, folder):
    fits = fit_numeric(labelled_documents(spark, folder), ["n_chars", "quality", "toxic"])
    frame = spark.createDataFrame([(f.name, f.median, f.mean, f.scale) for f in fits], "column string, median double, mean double, scale double")
    return frame.select("column", *[F.round(c, 4).alias(c) for c in ("median", "mean", "scale")])


@query(
    f"""WITH src AS {LABELLED}, m AS (SELECT median(n_chars)::DOUBLE AS m1, median(toxic)::DOUBLE AS m2 FROM src),
s AS (SELECT m1, m2, avg(coalesce(n_chars, m1)) AS a1, stddev_pop(coalesce(n_chars, m1)) AS s1,
avg(coalesce(toxic, m2)) AS a2, stddev_pop(coalesce(toxic, m2)) AS s2 FROM src, m GROUP BY m1, m2),
l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS p FROM (SELECT DISTINCT lang FROM src))
SELECT doc_id, round((coalesce(n_chars, m1) - a1) / s1, 4) AS n_chars, round((coalesce(toxic, m2) - a2) / s2, 4) AS toxic, l.p AS lang_place
FROM src CROSS JOIN s JOIN l ON l.lang = src.lang"""
)
def feature_vectors(spark, folder):
    frame = labelled_documents(spark, folder)
    fitted = fit_features(frame, ["n_chars", "toxic"], ["lang", "source"])
    shaped = fitted.model.transform(frame)
    return shaped.select(
        "doc_id", F.round("_num_0", 4).alias("n_chars"), F.round("_num_1", 4).alias("toxic"),
        F.array_position(vector_to_array("_hot_0"), 1.0).alias("lang_place"),
    )


@query(
    """WITH long AS (SELECT 'lang' AS "column", lang AS v FROM documents UNION ALL SELECT 'source', "source" FROM documents),
c AS (SELECT "column", v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS p, count(*) OVER (PARTITION BY "column") AS k FROM c)
SELECT "column", v AS most_frequent, k AS categories FROM r WHERE p = 1"""
)
def category_fill(spark, folder):
    fits = fit_categories(table(spark, folder, "documents"), ["lang", "source"])
    return spark.createDataFrame([(f.name, f.most_frequent, len(f.categories)) for f in fits], "column string, most_frequent string, categories bigint")


# -- linear models against their closed forms -------------------------------------------


def _one_feature(spark, folder, algorithm):
    items = table(spark, folder, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000 + 2 * F.col("l_quantity")).alias(LABEL))
    features = fit_features(items, ["l_quantity"], [])
    fitted = fit_model(algorithm, "regression", features.model.transform(items), features, 0)
    model = fitted.stages[0]
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double").select(
        F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept")
    )


_ONE_FEATURE = """WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 + 2 * l_quantity AS y FROM lineitem),
s AS (SELECT covar_pop(x, y) / stddev_pop(x) AS b, avg(y) AS a, count(*) AS n FROM d) """


@query(_ONE_FEATURE + "SELECT round(b, 3) AS slope, round(a, 3) AS intercept FROM s")
def linear_fit(spark, folder):
    return _one_feature(spark, folder, "linear_regression")


@query(_ONE_FEATURE + "SELECT round(b * n / (n + 1.0), 3) AS slope, round(a, 3) AS intercept FROM s")
def ridge_fit(spark, folder):
    return _one_feature(spark, folder, "ridge")


@query(_ONE_FEATURE + "SELECT round(greatest(abs(b) - 0.01, 0) * sign(b), 3) AS slope, round(a, 3) AS intercept FROM s")
def lasso_fit(spark, folder):
    return _one_feature(spark, folder, "lasso")


# -- evaluation ---------------------------------------------------------------------


def _rule(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "quality", (F.col("n_chars") > 500).cast("int").alias("guess"),
        (F.col("n_chars") > 500).cast("int").cast("double").alias("guess_number"),
    )


_RULE = "(SELECT l.doc_id, l.quality, (d.n_chars > 500)::INT AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_CLASS_SQL = f"""WITH p AS {_RULE}, k AS (SELECT DISTINCT unnest([quality, guess]) AS c FROM p),
m AS (SELECT c, (SELECT count(*) FROM p WHERE quality = c) AS s, (SELECT count(*) FROM p WHERE guess = c) AS g,
(SELECT count(*) FROM p WHERE quality = c AND guess = c) AS h FROM k),
q AS (SELECT s, h, CASE WHEN g = 0 THEN 0 ELSE h / g END AS pr, CASE WHEN s = 0 THEN 0 ELSE h / s END AS re FROM m)
SELECT sum(s)::BIGINT AS "rows", round(sum(h) / sum(s), 4) AS accuracy, round(sum(pr * s) / sum(s), 4) AS precision_weighted,
round(sum(re * s) / sum(s), 4) AS recall_weighted,
round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * s) / sum(s), 4) AS f1_weighted"""


@query(_CLASS_SQL + " FROM q")
def class_metrics(spark, folder):
    return classification_metrics(confusion_counts(_rule(spark, folder), "quality", "guess"))


@query(_CLASS_SQL + ", 0::BIGINT AS skipped FROM q")
def class_metrics_of_scored(spark, folder):
    """Actual classes as integers, predicted ones as doubles."""
    return evaluate_predictions(_rule(spark, folder), "quality", "guess_number", "classification")


@query(
    f"""WITH p AS {_RULE}, k AS (SELECT DISTINCT unnest([quality, guess]) AS c FROM p)
SELECT a.c::VARCHAR AS actual, b.c::VARCHAR AS predicted, (SELECT count(*) FROM p WHERE quality = a.c AND guess = b.c) AS n
FROM k a CROSS JOIN k b"""
)
def confusion(spark, folder):
    return confusion_matrix(confusion_counts(_rule(spark, folder), "quality", "guess"))


_ERRORS = """SELECT count(*) AS "rows", round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2_score"""


@query(_ERRORS + " FROM (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)")
def regression_quality(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 2000.0)
    return regression_metrics(items, "l_extendedprice", "guess")


@query(
    _ERRORS
    + f""", (SELECT count(*) - count(quality) FROM {LABELLED} AS s2) AS skipped
FROM (SELECT quality::DOUBLE AS y, toxic * 0.5 AS p FROM {LABELLED} AS s1 WHERE quality IS NOT NULL AND toxic IS NOT NULL)"""
)
def regression_quality_of_scored(spark, folder):
    frame = labelled_documents(spark, folder).withColumn("guess", (F.col("toxic") * 0.5).cast("string"))
    return evaluate_predictions(frame, "quality", "guess", "regression")


@query(
    _CLASS_SQL.replace("SELECT sum(s)::BIGINT", ", e AS (SELECT sum(s)::BIGINT")
    + """ FROM q) SELECT 0::INTEGER AS position, 'algorithm=length rule' AS statement FROM e
UNION ALL SELECT 1, 'accuracy=' || accuracy || ' f1_weighted=' || f1_weighted FROM e
UNION ALL SELECT 2, 'band=' || CASE WHEN f1_weighted >= 0.85 THEN 'strong' WHEN f1_weighted >= 0.65 THEN 'moderate' ELSE 'weak' END FROM e"""
)
def metric_explanation(spark, folder):
    return explain_model(class_metrics(spark, folder), "classification", "length rule")


@query("SELECT CASE WHEN count(*) < 200 THEN 'ridge' ELSE 'random_forest' END AS recommended FROM part")
def model_recommendation(spark, folder):
    rows = table(spark, folder, "part").count()
    return recommend_model(spark, "regression", rows, True, True).select("recommended")


@query(
    """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, coalesce(c_mktsegment, '') AS c_mktsegment
FROM customer ORDER BY customer.c_custkey LIMIT 10"""
)
def scored_preview(spark, folder):
    return preview(table(spark, folder, "customer").drop("c_acctbal"), ["c_custkey"])


# -- nearest neighbours -------------------------------------------------------------


def _embedded(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )


_NEAREST = """WITH d AS (SELECT q.vec_id AS q, k.vec_id AS i, k.label AS label,
list_sum(list_transform(list_zip(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM embeddings q CROSS JOIN embeddings k),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS p FROM d), n AS (SELECT * FROM r WHERE p <= 5) """
_VOTED = _NEAREST + """, c AS (SELECT q, label, count(*) AS k FROM n GROUP BY ALL)
SELECT q AS query_id, label::DOUBLE AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k DESC, label) AS z FROM c) WHERE z = 1"""


@query(_VOTED)
def neighbour_vote(spark, folder):
    rows = _embedded(spark, folder)
    return vote(nearest(rows, rows.drop("label")))


@query(_VOTED)
def neighbour_vote_by_cells(spark, folder):
    """The path for known rows too many to share: cells, blocks and pruning."""
    rows = _embedded(spark, folder)
    return vote(nearest(rows, rows.drop("label"), shared_bytes=0, block_rows=1_000))


@query(_NEAREST + "SELECT q AS query_id, round(avg(label), 4) AS prediction FROM n GROUP BY q")
def neighbour_average(spark, folder):
    rows = _embedded(spark, folder)
    return average(nearest(rows, rows.drop("label"))).select("query_id", F.round("prediction", 4).alias("prediction"))


@query(
    """SELECT 'approximate' AS fidelity, count(*) AS queries, 5 * count(*) AS neighbours, true AS nine_tenths_found FROM embeddings"""
)
def neighbour_recall(spark, folder):
    """Neighbours searched around two thirds of the centres, against the exact ones: these vectors
    hardly form groups, so that fewer centres miss over a tenth."""
    rows = _embedded(spark, folder)
    probes = 2 * math.isqrt(rows.count()) // 3
    exact = nearest(rows, rows.drop("label")).select("query_id", "neighbour_id")
    found = nearest(rows, rows.drop("label"), shared_bytes=0, block_rows=100, probes=probes).select("query_id", "neighbour_id")
    both = exact.withColumn("wanted", F.lit(1)).join(found.withColumn("got", F.lit(1)), ["query_id", "neighbour_id"], "full")
    return both.agg(
        F.lit("approximate").alias("fidelity"), F.count_distinct("query_id").alias("queries"), F.count("got").alias("neighbours"),
        (F.count_if(F.col("wanted").isNotNull() & F.col("got").isNotNull()) >= 0.9 * F.count("wanted")).alias("nine_tenths_found"),
    )


# -- dictionaries too large to list ---------------------------------------------------


def _order_texts(spark, folder):
    return table(spark, folder, "lineitem").select("l_quantity", F.concat(F.lit("order "), "l_orderkey").alias("order"), "l_returnflag")


@query(
    """WITH k AS (SELECT 'order ' || l_orderkey AS o, l_returnflag AS f FROM lineitem),
o AS (SELECT o, row_number() OVER (ORDER BY o) AS p FROM (SELECT DISTINCT o FROM k)),
f AS (SELECT f, row_number() OVER (ORDER BY f) AS p FROM (SELECT DISTINCT f FROM k))
SELECT o AS "order", 1 + o.p - 1 AS order_place, 1 + (SELECT count(*) FROM o) + f.p - 1 AS flag_place, count(*) AS n
FROM k JOIN o USING (o) JOIN f USING (f) GROUP BY ALL"""
)
def wide_categories(spark, folder):
    """One-hot places of a column with a category per order, numbered and looked up in a table."""
    items = _order_texts(spark, folder)
    fitted = fit_features(items, ["l_quantity"], ["order", "l_returnflag"], held=100)
    # of the sparse vectors the places alone: the number's, the order's and the flag's
    shaped = fitted.model.transform(items).select("order", F.from_json(F.to_json(F.struct(FEATURES)), f"`{FEATURES}` struct<indices: array<bigint>>")[FEATURES]["indices"].alias("at"))
    return shaped.select("order", F.get("at", F.lit(1)).alias("order_place"), F.get("at", F.lit(2)).alias("flag_place")).groupBy(
        "order", "order_place", "flag_place"
    ).agg(F.count("*").alias("n"))


_ITEM_KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _many_classes(spark, folder):
    items = table(spark, folder, "lineitem").select(*_ITEM_KEY, F.concat(F.lit("part "), "l_partkey").alias("part"))
    return prepare(items, "part", _ITEM_KEY, held_classes=50)


@query(_QUOTAS.format(label="'part ' || l_partkey", table="lineitem"))
def many_class_split(spark, folder):
    """As ``stratified_split``, with a class per part."""
    done = _many_classes(spark, folder)
    marked = assign_split(done.frame, 0.2, _ITEM_KEY, LABEL, done.class_count)
    return marked.groupBy(F.col("part").alias("class")).agg(F.count("*").alias("rows"), F.count_if(F.col(IS_TEST)).alias("test_rows"))


@query(
    """SELECT 'part ' || l_partkey AS class, (dense_rank() OVER (ORDER BY 'part ' || l_partkey) - 1)::DOUBLE AS code, count(*) AS n
FROM lineitem GROUP BY 1, l_partkey"""
)
def many_class_codes(spark, folder):
    """A target with a class per part, numbered in a table."""
    done = _many_classes(spark, folder)
    return done.frame.groupBy(F.col("part").alias("class"), F.col(LABEL).alias("code")).agg(F.count("*").alias("n"))


# -- training, comparison, scoring ----------------------------------------------------
# twins state the sizes of the split and that a model beats the best constant guess


def _measured(result, df, target):
    """``algorithm, fidelity, train_rows, test_rows, beats_constant``."""
    spark = df.sparkSession
    row = result.metrics.first()
    if result.model.task_type == "classification":
        # the most frequent class is right as often as it occurs
        most = df.filter(F.col(target).isNotNull()).groupBy(target).count().agg(F.max("count"), F.sum("count")).first()
        better = row["accuracy"] > most[0] / most[1]
    else:
        better = row["r2_score"] > 0.0
    about = result.model.metadata()
    return spark.createDataFrame(
        [(about["algorithm"], about["fidelity"], result.train_rows, result.test_rows, bool(better))],
        "algorithm string, fidelity string, train_rows bigint, test_rows bigint, beats_constant boolean",
    )


def _trained_sql(algorithm, fidelity, source):
    return f"""SELECT '{algorithm}' AS algorithm, '{fidelity}' AS fidelity, (n - ceil(n * 0.2))::BIGINT AS train_rows,
ceil(n * 0.2)::BIGINT AS test_rows, true AS beats_constant FROM (SELECT count(*) AS n FROM {source})"""


def _documents(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").drop("toxic")


_LABELLED_ROWS = "documents JOIN labels USING (doc_id)"


def _long_documents(spark, folder):
    """Labelled documents with a class that their length decides."""
    return _documents(spark, folder).withColumn("size_class", F.when(F.col("n_chars") > 1500, "long").otherwise("short")).drop("quality")


def _sized_parts(spark, folder):
    """Parts with a class that holds on a middle range of sizes: no straight line finds it."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return part.withColumn("middle", F.when(F.col("p_size").between(14, 37), "yes").otherwise("no"))


def _curved_parts(spark, folder):
    """Parts with a number that rises and falls with their size."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_brand")
    return part.withColumn("bend", (F.col("p_size") - 25) * (F.col("p_size") - 25) / 100.0)


@query(_trained_sql("logistic_regression", "exact", _LABELLED_ROWS))
def trained_logistic(spark, folder):
    frame = _long_documents(spark, folder)
    return _measured(train(frame, "size_class", "logistic_regression", key=["doc_id"]), frame, "size_class")


@query(_trained_sql("decision_tree", "binned", "part"))
def trained_tree(spark, folder):
    frame = _curved_parts(spark, folder)
    return _measured(train(frame, "bend", "decision_tree", key=["p_partkey"]), frame, "bend")


@query(_trained_sql("random_forest", "binned", "part"))
def trained_forest(spark, folder):
    """All 120 trees, as deep as they go."""
    frame = _curved_parts(spark, folder)
    return _measured(train(frame, "bend", "random_forest", key=["p_partkey"]), frame, "bend")


@query(_trained_sql("extra_trees", "exact", "part"))
def trained_extra_trees(spark, folder):
    frame = _sized_parts(spark, folder)
    return _measured(train(frame, "middle", "extra_trees", key=["p_partkey"]), frame, "middle")


@query(_trained_sql("svm", "approximate", "part"))
def trained_kernel_machine(spark, folder):
    frame = _sized_parts(spark, folder)
    return _measured(train(frame, "middle", "svm", key=["p_partkey"]), frame, "middle")


@query(_trained_sql("svm", "approximate", "part"))
def trained_kernel_regression(spark, folder):
    frame = _curved_parts(spark, folder)
    return _measured(train(frame, "bend", "svm", key=["p_partkey"]), frame, "bend")


@query(_trained_sql("knn", "exact", _LABELLED_ROWS))
def trained_neighbours(spark, folder):
    frame = _long_documents(spark, folder)
    return _measured(train(frame, "size_class", "knn", key=["doc_id"]), frame, "size_class")


@query(_trained_sql("ridge", "exact", "lineitem"))
def trained_ridge(spark, folder):
    """All columns, the ship date's days as categories among them."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) + 10 * F.col("l_quantity")
    frame = table(spark, folder, "lineitem").withColumn("charge", charge)
    return _measured(train(frame, "charge", "ridge"), frame, "charge")


@query("SELECT 'numeric__p_size' AS feature, true AS first, true AS adds_up")
def forest_importance(spark, folder):
    found = train(_sized_parts(spark, folder), "middle", "random_forest", key=["p_partkey"]).importance
    return found.agg(
        F.max_by("feature", "importance").alias("feature"), (F.min_by("rank", -F.col("importance")) == 1).alias("first"),
        F.sum("importance").between(0.9, 1.01).alias("adds_up"),
    )


def _board_sql(names, source):
    listed = ", ".join(f"('{name}', '{fidelity}')" for name, fidelity in names)
    return f"""SELECT name AS algorithm, kind AS fidelity, NULL::VARCHAR AS error, n AS "rows", (n - ceil(n * 0.2))::BIGINT AS train_rows,
ceil(n * 0.2)::BIGINT AS test_rows FROM (VALUES {listed}) AS t(name, kind) CROSS JOIN (SELECT count(*) AS n FROM {source})"""


_FAMILIES = [("decision_tree", "binned"), ("random_forest", "binned"), ("extra_trees", "exact")]


@query(_board_sql([("logistic_regression", "exact"), *_FAMILIES], _LABELLED_ROWS))
def model_leaderboard(spark, folder):
    return compare_models(_documents(spark, folder), "quality", key=["doc_id"]).drop("metrics", "rank", "score")


@query(_board_sql([("linear_regression", "exact"), ("ridge", "exact"), *_FAMILIES], "part"))
def regression_leaderboard(spark, folder):
    return compare_models(table(spark, folder, "part"), "p_retailprice", key=["p_partkey"]).drop("metrics", "rank", "score")


@query("SELECT true AS best_is_a_tree, 'r2_score' AS ranked_by, true AS well_fitted, CASE WHEN count(*) < 100 THEN 1 ELSE 0 END AS warnings FROM part")
def comparison_summary(spark, folder):
    """A target that only trees can follow."""
    board = compare_models(_curved_parts(spark, folder), "bend", key=["p_partkey"])
    return comparison_result(board, "regression").select(
        F.col("best").isin([name for name, _ in _FAMILIES]).alias("best_is_a_tree"), "ranked_by",
        (F.col("score") > 0.9).alias("well_fitted"), F.size("warnings").alias("warnings"),
    )


@query("SELECT doc_id, true AS scored, true AS right_if_clear FROM documents")
def batch_scores(spark, folder):
    """Train on labelled documents, save, load, score all documents; those far from the limit are
    to be right."""
    result = train(_long_documents(spark, folder), "size_class", "logistic_regression", key=["doc_id"])
    path = save_model(spark, result.model, f"{shared_folder(spark)}/models")
    remove_at_end(spark, path)
    scored = score(load_model(spark, path), table(spark, folder, "documents"))
    guess = F.col("predicted_size_class")
    clear = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") > 6000, "long").otherwise(guess)
    return scored.select("doc_id", guess.isin("long", "short").alias("scored"), (guess == clear).alias("right_if_clear"))


def _tree_scores(spark, folder):
    frame = _sized_parts(spark, folder)
    result = train(frame, "middle", "decision_tree", key=["p_partkey"])
    return result.model, score(result.model, frame)


@query("SELECT count(*) AS \"rows\", 0::BIGINT AS skipped, true AS well_fitted FROM part")
def scored_metrics(spark, folder):
    found = external_metrics(*_tree_scores(spark, folder))
    return found.select("rows", "skipped", (F.least("accuracy", "f1_weighted") > 0.9).alias("well_fitted"))


@query(
    """SELECT CASE WHEN p_size BETWEEN 14 AND 37 THEN 'yes' ELSE 'no' END AS actual, count(*) AS n, true AS mostly_right FROM part GROUP BY 1"""
)
def external_confusion_rows(spark, folder):
    counts = external_confusion(*_tree_scores(spark, folder))
    right = F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0))
    return counts.groupBy("actual").agg(F.sum("n").alias("n"), (right > 0.9 * F.sum("n")).alias("mostly_right"))
