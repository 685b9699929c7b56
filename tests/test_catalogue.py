import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import registry
from tablewright.operators.training import train
from tablewright.sources.catalogue import Catalogue


@pytest.fixture
def catalogue(spark, tmp_path):
    return Catalogue(spark, str(tmp_path / "catalogue"))


def test_dataset_registration(spark, catalogue, tmp_path):
    paths = []
    for i, text in enumerate(["a,b\n1,2\n1,2\n", "a,b\n1,\n", "a,b\n1,2\n1,2\n"]):
        path = tmp_path / f"{i}.csv"
        path.write_text(text)
        paths.append(str(path))
    read = lambda p: spark.read.option("header", True).csv(p)
    ids = [catalogue.register_dataset(p, f"{i}.csv", read(p)) for i, p in enumerate(paths)]
    assert ids == [1, 2, 1]
    row = registry.get_dataset(catalogue.table("datasets"), 1).first()
    assert (row["rows"], row["columns"], row["duplicate_rows"], row["original_filename"]) == (2, 2, 1, "0.csv")
    (tmp_path / "bad.csv").write_text("?")
    assert catalogue.register_dataset(str(tmp_path / "bad.csv"), "bad.csv", None) == 3
    assert registry.get_dataset(catalogue.table("datasets"), 3).first()["error"]
    assert registry.list_datasets(catalogue.table("datasets")).count() == 3


def test_experiments_and_lineage(spark, catalogue, tmp_path):
    (tmp_path / "d.csv").write_text("x,y\n" + "\n".join(f"{i},{i * 2}" for i in range(40)))
    df = spark.read.option("header", True).csv(str(tmp_path / "d.csv")).selectExpr("int(x) x", "int(y) y")
    dataset = catalogue.register_dataset(str(tmp_path / "d.csv"), "d.csv", df)
    first = train(df, "y", "ridge", key=["x"])
    second = train(df, "y", "linear_regression", key=["x"])
    assert [catalogue.record_training(r, dataset) for r in (first, second)] == [1, 2]
    assert [r["id"] for r in catalogue.experiments(dataset).collect()] == [2, 1]
    assert [r["id"] for r in catalogue.experiments(limit=1).collect()] == [2]
    assert registry.experiments_of_model(catalogue.table("experiments"), first.model.model_id).count() == 1
    assert registry.get_experiment(catalogue.table("experiments"), 1).first()["dataset_info"]["rows"] == 40
    lines = {r["model_id"]: (r["experiment_id"], r["filename"]) for r in catalogue.lineage().collect()}
    assert lines == {first.model.model_id: (1, "d.csv"), second.model.model_id: (2, "d.csv")}
    best = catalogue.table("experiments").select(registry.primary_metric(F.col("metrics")).alias("m")).first()["m"]
    assert best["name"] == "r2_score"
    with pytest.raises(ValueError, match="not registered"):
        catalogue.log_experiment(99, "ridge")
    assert catalogue.models(stage="development").count() == 2
    assert catalogue.models(algorithm="ridge").first()["model_id"] == first.model.model_id


def test_stages(catalogue):
    catalogue.register_model("m", {"algorithm": "ridge", "target_column": "y"})
    catalogue.register_model("m", {"algorithm": "lasso"})
    model = catalogue.models().first()
    assert model["metadata"] == {"algorithm": "lasso", "target_column": "y", "model_id": "m"}
    catalogue.transition("m", "production")
    assert [tuple(r) for r in catalogue.production().collect()] == [("m", "1.0.0")]
    catalogue.transition("m", "staging", "1.9.0")
    catalogue.transition("m", "staging", "1.10.0")
    catalogue.transition("m", "archived")  # the highest is 1.10.0
    stages = {r["version"]: r["stage"] for r in registry.current_stages(catalogue.table("stage_log")).collect()}
    assert stages == {"1.0.0": "production", "1.9.0": "staging", "1.10.0": "archived"}
    assert catalogue.models(stage="archived").count() == 1 and catalogue.models(stage="production").count() == 0
    with pytest.raises(ValueError, match="stage"):
        catalogue.transition("m", "live")
    with pytest.raises(ValueError, match="not registered"):
        catalogue.transition("n", "staging")


def test_ids_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as v").repartition(9)
    rows = registry.assign_ids(df, 11, ["v"]).collect()
    assert sorted((r["v"], r["id"]) for r in rows) == [(i, i + 11) for i in range(1000)]


def test_metadata_merges_by_time(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("m", at, {"a": "1", "b": "1"}), ("m", at + dt.timedelta(days=1), {"b": "2", "c": "2"}), ("n", at, {})]
    log = spark.createDataFrame(rows, registry.MODEL_LOG_SCHEMA)
    found = {r["model_id"]: r["metadata"] for r in registry.current_models(log).collect()}
    assert found == {"m": {"a": "1", "b": "2", "c": "2"}, "n": None}


def test_odd_versions_rank_lowest(spark):
    rows = [("m", v, "staging", dt.datetime(2024, 1, 1)) for v in ("beta", "0.0.1", "0.10", "0.9.9")]
    log = spark.createDataFrame(rows, registry.STAGE_LOG_SCHEMA)
    assert registry.latest_versions(log).first()["version"] == "0.10"


def test_lineage_holds_one_join_in_a_task(spark, capsys):
    from pyspark.sql import functions as F

    from tablewright.operators.registry import lineage

    models = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "2"), ("b", None), (None, "1"), ("c", "x")], "model_id string, dataset string"
    ).select("model_id", F.create_map(F.lit("dataset_id"), F.col("dataset")).alias("metadata"))
    runs = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, None, 1), (4, "z", 1)], "id bigint, model_id string, dataset_id bigint")
    datasets = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, original_filename string")
    found = lineage(models, runs, datasets)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert rows == sorted(
        [("a", 1, 2, "two"), ("a", 1, 2, "two"), ("a", 2, 1, "one"), ("a", 2, 2, "two"), ("b", None, 2, "two"),
         ("b", None, None, None), ("c", None, None, None), (None, None, 1, "one")], key=str,
    )
    # models without runs are dealt out anew, apart from those with runs
    found.explain("extended")
    assert "RebalancePartitions" in capsys.readouterr().out
