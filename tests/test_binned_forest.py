import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import binned_forest
from tablewright.operators.binned_forest import counted, cuts_of, fit_binned_forest, grow
from tablewright.operators.models import Settings
from tablewright.operators.random_trees import RandomTrees
from tablewright.operators.training import train


def _rows(spark, n):
    """Numbers that agree in few bins, whatever the number of rows."""
    df = spark.range(n).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.withColumn("y", F.col("a") * F.col("a") - 3 * F.col("b")))


def _shaped(tree, x):
    return tree.value[tree.leaves(x), 0]


def _plain(x, y, w, depth, cuts):
    """Prediction of each row by a tree grown one node at a time."""
    out = np.zeros(len(y))

    def node(rows, left):
        mean = (w[rows] * y[rows]).sum() / w[rows].sum()
        best = (1e-9, None)
        for f, own in enumerate(cuts) if left else ():
            for c in own:
                a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if len(a) and len(b):
                    spread = [(w[r] * (y[r] - (w[r] * y[r]).sum() / w[r].sum()) ** 2).sum() for r in (rows, a, b)]
                    if spread[0] - spread[1] - spread[2] > best[0] + 1e-9:
                        best = (spread[0] - spread[1] - spread[2], (a, b))
        if best[1] is None:
            out[rows] = mean
        else:
            for side in best[1]:
                node(side, left - 1)

    node(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
@pytest.mark.parametrize("bytes_of_level", [32, 32_000_000])
def test_trees_are_those_of_plain_loops(monkeypatch, depth, bytes_of_level):
    monkeypatch.setattr(binned_forest, "LEVEL_BYTES", bytes_of_level)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 5, (200, 3)).astype("u1")
    codes[:, 2] = 0  # a feature without cuts
    y, w = rng.normal(size=200) + 100, rng.integers(1, 4, 200).astype("f8")
    cuts = [np.arange(4.0), np.arange(4.0), np.zeros(0)]
    tree, gone = grow(codes, w, w * y, cuts, depth)
    assert np.allclose(_shaped(tree, codes.astype("f8")), _plain(codes, y, w, depth, cuts))
    assert (gone[2], gone[:2].min() > 0) == (0.0, depth > 1)


def test_rows_that_agree_are_counted(spark):
    df = _rows(spark, 21_000)
    cuts = cuts_of(df, "x", 2)
    assert [c.tolist() for c in cuts] == [[0.5, 1.5, 2.5, 3.5, 4.5, 5.5], [0.5, 1.5]]
    found = counted(df, "x", "y", cuts).collect()
    assert sorted(r["n"] for r in found) == [1_000] * 21


def test_a_leaf_holds_one_value(spark):
    """Rows of one value are not split over rounding, however many they are."""
    df = _rows(spark, 21_000).withColumn("y", F.col("y") / 3 + 0.1)
    forest, importances = fit_binned_forest(df, "x", "y", "guess", 2, 5, 30, 1)
    assert all((t.feature < 0).sum() <= 21 for t in forest.trees)
    far = forest.transform(df).agg(F.max(F.abs(F.col("guess") - F.col("y")))).first()[0]
    assert far < 1e-9 and abs(sum(importances) - 1) < 1e-9


def test_many_values_are_cut_at_quantiles(spark):
    df = VectorAssembler(inputCols=["v"], outputCol="x").transform(spark.range(5_000).select(F.col("id").cast("double").alias("v")))
    (cuts,) = cuts_of(df, "x", 1)
    assert len(cuts) == 31 and np.abs(cuts - np.arange(1, 32) * 5_000 / 32).max() < 20


def test_few_counts_are_shared_and_many_are_not(spark, monkeypatch):
    df = _rows(spark, 2_100).drop("x").withColumn("k", F.monotonically_increasing_id())
    few = Settings(trees=10, forest_depth=8)
    own = train(df, "y", "random_forest", key=["k"], settings=few)
    assert isinstance(own.model.pipeline.stages[-1], RandomTrees) and own.metrics.first()["r2_score"] > 0.95
    monkeypatch.setattr(binned_forest, "SHARED_BYTES", 1_000)
    spark_own = train(df, "y", "random_forest", key=["k"], settings=few)
    assert not isinstance(spark_own.model.pipeline.stages[-1], RandomTrees) and spark_own.metrics.first()["r2_score"] > 0.95
