"""Categories and classes too many to list: tables beside lists."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions.numbering import numbered
from tablewright.operators import split, training
from tablewright.operators.models import LIGHT
from tablewright.operators.prepare import FEATURES, LABEL, fit_features, prepare
from tablewright.operators.scoring import external_metrics, score
from tablewright.operators.split import IS_TEST, assign_split
from tablewright.operators.training import train
from tablewright.sources.models import load_model, save_model


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 as v", "cast(id % 3 as int) as g").repartition(9)
    assert sorted((r["v"], r["place"]) for r in numbered(df, ["v"]).collect()) == [(i, i) for i in range(5000)]
    within = numbered(df, ["g", "v"], within="g").collect()
    for g in range(3):
        rows = sorted((r["v"], r["place"]) for r in within if r["g"] == g)
        assert [p for _, p in rows] == list(range(len(rows)))
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_vectors_by_table_are_the_listed_ones(spark):
    rows = [(f"c{i * 37 % 400}", "it's" if i % 3 else None, float(i), i % 2 == 0 if i % 5 else None) for i in range(1000)]
    frame = spark.createDataFrame(rows, "a string, b string, x double, f boolean")
    new = frame.limit(40).unionByName(spark.createDataFrame([("unseen", None, None, None), (None, "zz", 2.0, True)], frame.schema)).withColumn("k", F.monotonically_increasing_id())
    listed = fit_features(frame, ["x"], ["a", "b", "f"])
    tabled = fit_features(frame, ["x"], ["a", "b", "f"], held=10)
    assert listed.table is None and tabled.table is not None and tabled.width == listed.width == 404

    def vectors(fitted):
        out = fitted.model.transform(new).select("k", vector_to_array(FEATURES).alias("v")).collect()
        return {r["k"]: r["v"] for r in out}

    assert vectors(tabled) == vectors(listed)
    wanted = [0, 1, 77, 400, 401, 402, 403]
    assert tabled.names_of(spark, wanted) == listed.names_of(spark, wanted) == {i: listed.names[i] for i in wanted}


def test_many_categories_train_save_and_score(spark, tmp_path):
    """240,000 categories: the table is joined, saved and loaded; the driver lists none."""
    df = spark.range(300_000).selectExpr("id AS k", "concat('c', id % 240000) AS c", "cast(id % 240000 % 2 AS double) * 10 + id % 3 AS y")
    result = train(df, "y", "ridge", key=["k"])
    features = result.model.pipeline.stages[1]
    # four fifths of the rows are in the training part, so most categories
    assert 200_000 < sum(features.getOrDefault(features.sizes)) <= 240_000 and result.model.categorical == ["c"]
    back = load_model(spark, save_model(spark, result.model, str(tmp_path)))
    # categories with two rows are known from their other row
    scored = score(back, df.filter("k < 60000 OR k >= 240000").drop("y"))
    both = df.join(scored.select("k", "predicted_y"), "k")
    right = both.agg(F.corr("y", "predicted_y")).first()[0]
    assert both.count() == 120_000 and right > 0.6


def test_wide_vectors_are_refused_where_rows_are_dense(spark):
    df = spark.range(30_000).selectExpr("id AS k", "concat('c', id % 12000) AS c", "cast(id % 2 AS string) AS y")
    for algorithm in ("knn", "extra_trees", "svm"):
        with pytest.raises(ValueError, match="dense rows"):
            train(df, "y", algorithm, key=["k"], settings=LIGHT)


def test_classes_by_table_are_the_listed_ones(spark):
    df = spark.range(4000).selectExpr("id AS k", "concat('c', id * id % 97) AS y", "id % 11 AS x")
    listed, tabled = prepare(df, "y", ["k"]), prepare(df, "y", ["k"], held_classes=5)
    assert listed.classes and tabled.classes is None and tabled.class_count == len(listed.classes)
    assert [r["class"] for r in tabled.class_table.orderBy("label").collect()] == listed.classes

    def labels(p):
        return {r["k"]: r[LABEL] for r in p.frame.select("k", LABEL).collect()}

    assert labels(listed) == labels(tabled)


@pytest.mark.parametrize("ranked_rows", [3, 200_000])
def test_split_by_tables_is_the_listed_one(spark, monkeypatch, ranked_rows):
    monkeypatch.setattr(split, "RANKED_ROWS", ranked_rows)
    df = spark.range(6000).selectExpr("id", "cast(if(id % 3 < 2, 0, id % 500) as double) as _label")
    codes = numbered(df.select("_label").distinct(), ["_label"], "code").withColumnRenamed("_label", "was")
    df = df.join(codes, F.col("_label") == F.col("was")).select("id", F.col("code").cast("double").alias(LABEL)).checkpoint()
    classes = df.select(LABEL).distinct().count()

    def test_ids(listed):
        monkeypatch.setattr(split, "LISTED_CLASSES", listed)
        return {r["id"] for r in assign_split(df, 0.3, ["id"], LABEL, classes).filter(IS_TEST).collect()}

    assert test_ids(1) == test_ids(10_000) and len(test_ids(1)) == 1800
    few = df.filter("id < 600")
    with pytest.raises(ValueError, match="need as many rows"):
        monkeypatch.setattr(split, "LISTED_CLASSES", 1)
        assign_split(few.unionByName(few.withColumn("id", F.col("id") + 10_000)), 0.05, ["id"], LABEL, classes)


def test_small_classes_are_ranked_at_once(spark, monkeypatch):
    """Without counting hash prefixes first, from hashes that the look-up of classes brings along."""
    monkeypatch.setattr(split, "_cut_table", None)
    df = spark.range(4000).selectExpr("id AS k", "concat('c', id % 40) AS y")
    tabled = prepare(df, "y", ["k"], held_classes=5)
    monkeypatch.setattr(split, "LISTED_CLASSES", 1)
    marked = assign_split(tabled.frame, 0.2, ["k"], LABEL, 40)
    monkeypatch.setattr(split, "LISTED_CLASSES", 1000)
    listed = assign_split(prepare(df, "y", ["k"]).frame, 0.2, ["k"], LABEL, 40)
    assert {r["k"] for r in marked.filter(IS_TEST).collect()} == {r["k"] for r in listed.filter(IS_TEST).collect()}


def test_a_class_of_one_row_by_tables(spark, monkeypatch):
    monkeypatch.setattr(split, "LISTED_CLASSES", 1)
    df = spark.range(50).selectExpr("id", "cast(if(id = 7, 1, 0) as double) as _label")
    assert assign_split(df, 0.2, ["id"], LABEL, 2).filter(IS_TEST).count() == 10


def test_many_classes_are_measured_and_scored(spark, tmp_path, monkeypatch):
    """20,000 classes: neighbours vote on them; other families refuse before any work."""
    df = spark.range(120_000).selectExpr("id AS k", "concat('c', id % 20000) AS y", "cast(id % 20000 AS double) AS x")
    for algorithm in ("logistic_regression", "decision_tree", "svm"):
        with pytest.raises(ValueError, match="knn has no such limit"):
            train(df, "y", algorithm, key=["k"])
    result = train(df.drop("k"), "y", "knn")
    assert result.test_rows == 24_000 and result.metrics.first()["accuracy"] > 0.95
    assert result.confusion.agg(F.sum("n")).first()[0] == 24_000
    back = load_model(spark, save_model(spark, result.model, str(tmp_path)))
    assert back.metadata() == result.model.metadata() and back.classes is None
    scored = score(back, df.filter("k < 300"))
    assert scored.filter("y = predicted_y").count() > 290
    assert external_metrics(back, scored).first()["accuracy"] > 0.95
