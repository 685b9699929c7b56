import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators.metrics import (
    classification_metrics,
    confusion_counts,
    confusion_matrix,
    evaluate_predictions,
    regression_metrics,
)
from tablewright.operators.models import LIGHT, Settings, check_algorithm, fit_model
from tablewright.operators.neighbours import average, nearest, vote
from tablewright.operators.prepare import FEATURES, LABEL, fit_features, fit_numeric, prepare
from tablewright.operators.scoring import external_metrics, preview, score
from tablewright.operators.split import IS_TEST, assign_split, sample_rows, test_quotas as quotas
from tablewright.operators.training import compare_models, train
from tablewright.sources.models import load_model, save_model


# -- split --------------------------------------------------------------------------


def test_quotas_are_exact():
    assert quotas([37, 63], 0.2) == [7, 13]
    assert sum(quotas([3, 3, 3, 91], 0.25)) == 25
    assert quotas([23], 0.2, stratified=False) == [5]
    with pytest.raises(ValueError):
        quotas([2, 2, 2, 2], 0.2)


@pytest.mark.parametrize("ranked_rows", [3, 200_000])
def test_split_sizes_and_shares(spark, monkeypatch, ranked_rows):
    monkeypatch.setattr("tablewright.operators.split.RANKED_ROWS", ranked_rows)
    # two thirds of the rows are of one class
    df = spark.range(3000).selectExpr("id", "cast(if(id % 3 < 2, 0, id % 5) as double) as _label")
    marked = assign_split(df, 0.2, ["id"], LABEL, 5)
    sizes = {r["_label"]: (r["n"], r["t"]) for r in marked.groupBy("_label").agg(
        F.count("*").alias("n"), F.count_if(IS_TEST).alias("t")).collect()}
    assert sum(t for _, t in sizes.values()) == 600
    assert all(abs(t - n * 0.2) < 1 for n, t in sizes.values())


def test_split_ignores_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 4 as double) as _label")
    def test_ids(n):
        return {r["id"] for r in assign_split(df.repartition(n), 0.3, ["id"], LABEL, 4).filter(IS_TEST).collect()}
    assert test_ids(1) == test_ids(13) and len(test_ids(1)) == 300


def test_a_class_of_one_row_is_not_stratified(spark):
    df = spark.range(50).selectExpr("id", "cast(if(id = 7, 1, 0) as double) as _label")
    assert assign_split(df, 0.2, ["id"], LABEL, 2).filter(IS_TEST).count() == 10


def test_sample(spark):
    ids = [r["id"] for r in sample_rows(spark.range(5000), 800, ["id"]).collect()]
    again = [r["id"] for r in sample_rows(spark.range(5000).repartition(7), 800, ["id"]).collect()]
    assert len(set(ids)) == 800 and set(ids) == set(again)


# -- preparation --------------------------------------------------------------------


def test_guards(spark):
    few = spark.createDataFrame([(i, i) for i in range(9)], "x int, y int")
    with pytest.raises(ValueError, match="at least 10"):
        prepare(few, "y")
    with pytest.raises(ValueError, match="not found"):
        prepare(few, "z")
    one = spark.createDataFrame([(i, "a") for i in range(20)], "x int, y string")
    with pytest.raises(ValueError, match="2 target classes"):
        prepare(one, "y")
    keys = spark.createDataFrame([(f"k{i}", i % 2) for i in range(20)], "x string, y int")
    with pytest.raises(ValueError, match="feature"):
        prepare(keys, "y")
    gone = spark.createDataFrame([(i, None if i > 7 else i) for i in range(20)], "x int, y int")
    with pytest.raises(ValueError, match="too few"):
        prepare(gone, "y")
    with pytest.raises(ValueError, match="test_size"):
        train(few, "y", "ridge", test_size=1.0)
    with pytest.raises(ValueError, match="no rows"):
        train(few.limit(0), "y", "ridge")
    with pytest.raises(ValueError, match="no rows"):
        compare_models(few.limit(0), "y")


def test_share_of_distinct_values_right_at_the_limit(spark):
    rows = [(f"a{min(i, 94)}", f"b{min(i, 95)}", i % 2) for i in range(100)]
    assert prepare(spark.createDataFrame(rows, "a string, b string, y int"), "y").dropped == ["b"]


def test_boolean_target_and_classes(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "x int, y boolean")
    assert prepare(df, "y").classes == ["False", "True"]
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "x int, y double")
    assert prepare(df, "y").classes == ["0", "1", "2"]


def test_fill_and_scale_match_numpy(spark):
    draw = np.random.default_rng(2)
    x = np.where(draw.random(101) < 0.3, np.nan, draw.normal(5, 3, 101))
    df = spark.createDataFrame([(float(v), 4.0, None) for v in x], "x double, k double, none double")
    fits = {f.name: f for f in fit_numeric(df.select(F.nanvl("x", F.lit(None)).alias("x"), "k", "none"), ["x", "k", "none"])}
    filled = np.where(np.isnan(x), np.nanmedian(x), x)
    assert np.isclose(fits["x"].mean, filled.mean()) and np.isclose(fits["x"].scale, filled.std())
    assert (fits["k"].mean, fits["k"].scale) == (4.0, 1.0) and "none" not in fits


def test_unseen_and_missing_categories(spark):
    train_part = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False), ("a", 3.0, True), ("it's ${x}", None, None)], "c string, x double, f boolean")
    fitted = fit_features(train_part, ["x"], ["c", "f"])
    assert fitted.names == ["numeric__x", "categorical__c_a", "categorical__c_b", "categorical__c_it's ${x}", "categorical__f_False", "categorical__f_True"]
    new = spark.createDataFrame([("zzz", 2.0, False), (None, None, None), ("it's ${x}", 2.0, True)], "c string, x double, f boolean")
    rows = [list(r[0]) for r in fitted.model.transform(new).select(vector_to_array(FEATURES)).collect()]
    assert rows[0] == [0.0, 0, 0, 0, 1, 0]
    assert rows[1] == [0.0, 1, 0, 0, 0, 1]  # filled with the median, a and True
    assert rows[2] == [0.0, 0, 0, 1, 0, 1]


# -- models against independent solutions ---------------------------------------------


@pytest.fixture(scope="module")
def linear_case(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = x @ [1.5, -0.3, 4.0] + draw.normal(size=400)
    frame = spark.createDataFrame([(*map(float, r), float(v), float(v > y.mean())) for r, v in zip(x, y)], "a double, b double, c double, y double, k double")
    z = (x - x.mean(0)) / x.std(0)
    return frame, z, y


def _fit(frame, label, algorithm, task):
    frame = frame.withColumn(LABEL, F.col(label))
    features = fit_features(frame, ["a", "b", "c"], [])
    return fit_model(algorithm, task, features.model.transform(frame), features, 2).stages[0]


def test_ridge(linear_case):
    frame, z, y = linear_case
    model = _fit(frame, "y", "ridge", "regression")
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, want, atol=1e-6) and np.isclose(model.intercept, y.mean())


def test_lasso(linear_case):
    frame, z, y = linear_case
    model = _fit(frame, "y", "lasso", "regression")
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rest = (y - y.mean()) - z @ w + z[:, j] * w[j]
            rho = z[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.01, 0) / (z[:, j] @ z[:, j] / len(y))
    assert np.allclose(model.coefficients, w, atol=1e-5)


def test_logistic(linear_case):
    frame, z, y = linear_case
    k = (y > y.mean()).astype(float)
    model = _fit(frame, "k", "logistic_regression", "classification")
    w = np.zeros(4)
    x = np.c_[np.ones(len(k)), z]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.diag([0.0, 1, 1, 1])
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - k) + penalty @ w)
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-3)


def test_algorithm_names():
    assert check_algorithm("regression", " Ridge ") == "ridge"
    with pytest.raises(ValueError, match="choose from"):
        check_algorithm("classification", "ridge")


# -- metrics ------------------------------------------------------------------------


def test_class_metrics_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), (None, "a")]
    df = spark.createDataFrame(pairs, "y string, p string")
    counts = confusion_counts(df, "y", "p")
    row = classification_metrics(counts).first()
    # precision a 1, b 1/3, c 0; recall a 1/2, b 1, c 0
    assert row["rows"] == 4 and row["accuracy"] == 0.5
    assert row["precision_weighted"] == round((2 + 1 / 3) / 4, 4)
    assert row["recall_weighted"] == 0.5
    assert row["f1_weighted"] == round((2 * 2 / 3 + 0.5) / 4, 4)
    assert confusion_matrix(counts).count() == 9
    assert evaluate_predictions(df, "y", "p", "classification").first()["skipped"] == 1


def test_regression_metrics_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 2.0, 1.0)] * 3, "y double, right double, wrong double")
    assert regression_metrics(df, "y", "right").first()["r2_score"] == 1.0
    assert regression_metrics(df, "y", "wrong").first()["r2_score"] == 0.0
    assert regression_metrics(df.limit(1), "y", "right").first()["r2_score"] is None


# -- neighbours ---------------------------------------------------------------------


@pytest.mark.parametrize("shared_bytes,block_rows", [(64_000_000, 10_000), (0, 40), (0, 100_000)])
def test_neighbours_match_brute_force(spark, shared_bytes, block_rows):
    draw = np.random.default_rng(8)
    known = np.r_[np.zeros((200, 3)), draw.normal(size=(400, 3))]  # a third at one spot
    queries = np.r_[np.zeros((60, 3)), draw.normal(size=(60, 3))]
    labels = draw.integers(0, 3, len(known))
    k = spark.createDataFrame([(i, float(v), list(map(float, x))) for i, (x, v) in enumerate(zip(known, labels))], "id long, label double, vector array<double>")
    q = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(queries)], "id long, vector array<double>")
    found = nearest(k, q, 5, shared_bytes, block_rows).orderBy("query_id", "distance", "neighbour_id").collect()
    d = np.sqrt(((queries[:, None] - known[None]) ** 2).sum(2))
    want = [np.lexsort((np.arange(len(known)), row))[:5] for row in d]
    assert [r["neighbour_id"] for r in found] == [int(i) for row in want for i in row]
    votes = {r["query_id"]: r["prediction"] for r in vote(nearest(k, q, 5, shared_bytes, block_rows)).collect()}
    for i, row in enumerate(want):
        assert votes[i] == np.bincount(labels[row]).argmax()
    means = {r["query_id"]: r["prediction"] for r in average(nearest(k, q, 5, shared_bytes, block_rows)).collect()}
    assert np.isclose(means[3], labels[want[3]].mean())


def test_fewer_known_rows_than_neighbours(spark):
    k = spark.createDataFrame([(1, 1.0, [0.0]), (2, 2.0, [1.0])], "id long, label double, vector array<double>")
    q = k.select("id", "vector")
    assert nearest(k, q, 5).count() == 4 and nearest(k, q, 5, shared_bytes=0).count() == 4


# -- train, save, score --------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(spark):
    rows = []
    for i in range(120):
        rows.append((i, ["north", "south", None][i % 3], float(i % 10) if i % 11 else None, i % 4 == 0, "yes" if (i % 10) > 4 else "no", float(i % 10) * 3 + (i % 4)))
    return spark.createDataFrame(rows, "k long, region string, size double, member boolean, bought string, spent double")


@pytest.mark.parametrize("target,algorithm", [
    ("bought", "logistic_regression"), ("bought", "extra_trees"), ("bought", "svm"), ("bought", "knn"),
    ("region", "svm"), ("spent", "extra_trees"), ("spent", "knn"), ("spent", "lasso"),
])
def test_train_save_load_score(spark, shop, tmp_path, target, algorithm):
    result = train(shop, target, algorithm, key=["k"], settings=LIGHT)
    assert result.train_rows + result.test_rows == result.rows
    back = load_model(spark, save_model(spark, result.model, str(tmp_path)))
    assert back.metadata() == result.model.metadata()
    new = shop.withColumn("region", F.when(F.col("k") == 5, "west").otherwise(F.col("region"))).withColumn("extra", F.lit(1))
    scored = score(back, new)
    assert scored.columns == [*new.columns, f"predicted_{target}"]
    assert scored.count() == 120 and scored.filter(F.col(f"predicted_{target}").isNull()).count() == 0
    if back.classes:
        assert {r[0] for r in scored.select(f"predicted_{target}").distinct().collect()} <= set(back.classes)
    assert external_metrics(back, scored).count() == 1
    assert external_metrics(back, scored.drop(target)) is None
    with pytest.raises(ValueError, match="lacks"):
        score(back, new.drop("size"))


def test_forest_of_many_classes(spark):
    df = spark.range(3000).selectExpr("id AS k", "id % 150 AS code", "id % 150 + 0.5 AS near", "id % 7 AS other")
    df = df.withColumn("code", F.concat(F.lit("c"), "code"))
    few = Settings(trees=5, depth=12, forest_depth=12)
    result = train(df, "code", "random_forest", key=["k"], settings=few)
    assert len(result.model.classes) == 150 and result.metrics.first()["accuracy"] > 3 / 150
    assert result.confusion.agg(F.sum("n")).first()[0] == result.test_rows


def test_train_without_key(shop):
    result = train(shop, "spent", "ridge")
    assert (result.train_rows, result.test_rows) == (96, 24)
    assert result.explanation.count() == 3 and result.recommendation.first()["recommended"] == "ridge"
    assert result.importance.count() == 0


def test_compare(shop):
    board = compare_models(shop, "bought", key=["k"], max_rows=50).orderBy("rank").collect()
    assert [r["rank"] for r in board] == [1, 2, 3, 4]
    assert (board[0]["rows"], board[0]["train_rows"], board[0]["test_rows"]) == (120, 50, 24)
    scores = [r["score"] for r in board]
    assert scores == sorted(scores, reverse=True) and all(r["error"] is None for r in board)


def test_preview(spark):
    df = spark.createDataFrame([(2, float("inf"), None), (1, 1.5, "a")], "k int, x double, s string")
    assert [tuple(r) for r in preview(df, ["k"]).collect()] == [("1", "1.5", "a"), ("2", "", "")]
