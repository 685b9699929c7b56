import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import binned_forest, row_trees
from tablewright.operators.binned_forest import fit_binned_forest, grow_tight
from tablewright.operators.models import Settings
from tablewright.operators.random_trees import RandomTrees
from tablewright.operators.row_trees import Plain, TightRows
from tablewright.operators.training import train

from tests.test_row_trees import GROUPS, _frame, _mixed, _target


@pytest.mark.parametrize("step,level_bytes", [(1 << 17, 32_000_000), (9, 2_000)])
@pytest.mark.parametrize("depth", [0, 2, 30])
def test_tight_trees_are_those_of_dense_counts(monkeypatch, step, level_bytes, depth):
    monkeypatch.setattr(row_trees, "STEP", step)
    monkeypatch.setattr(binned_forest, "LEVEL_BYTES", level_bytes)
    _, codes, x = _mixed(5, 300)
    draw = np.random.default_rng(6)
    bins = draw.integers(0, 5, (300, 2)).astype("u1")
    dense = np.c_[bins, x[:, 2:]].astype("u1")
    y, w = draw.normal(size=300), draw.integers(0, 3, 300)
    cuts = [np.arange(4) + 0.5, np.arange(4) + 0.5, *[np.array([0.5])] * sum(GROUPS)]
    data = TightRows([Plain(b, np.arange(5.0)) for b in bins.T.copy()], [c.astype("u1") for c in codes], GROUPS, y)
    drawn = np.flatnonzero(w)
    one, gone = grow_tight(data, w, cuts, depth)
    two, want = binned_forest.grow(dense[drawn], w[drawn].astype("f8"), (w * y)[drawn], cuts, depth)
    at = dense[drawn].astype("f8")
    assert np.allclose(one.value[one.leaves(at)], two.value[two.leaves(at)]) and len(one.feature) == len(two.feature)
    assert np.allclose(gone.sum(), want.sum()) and (depth == 0 or gone.max() > 0)


def test_many_kinds_of_rows_are_still_counted(spark, monkeypatch):
    """Counts over what fits with a byte per feature grow trees as they are, not Spark's."""
    df = spark.range(3_000).select(
        F.concat(F.lit("c"), (F.col("id") * 7 % 40).cast("string")).alias("c"), (F.col("id") * 13 % 23).cast("double").alias("a"),
        ((F.col("id") * 13 % 23 - 11) * (F.col("id") * 13 % 23 - 11) + F.col("id") * 7 % 40 / 8).alias("y"), F.col("id").alias("k"),
    )
    few = Settings(trees=8, forest_depth=10)
    dense = train(df, "y", "random_forest", key=["k"], settings=few)
    monkeypatch.setattr(binned_forest, "DENSE_BYTES", 0)
    tight = train(df, "y", "random_forest", key=["k"], settings=few)
    for result in (dense, tight):
        assert isinstance(result.model.pipeline.stages[-1], RandomTrees) and result.metrics.first()["r2_score"] > 0.95
    assert abs(dense.metrics.first()["r2_score"] - tight.metrics.first()["r2_score"]) < 0.01


def test_draws_do_not_depend_on_how_features_are_kept(spark, monkeypatch):
    plain, codes, x = _mixed(7, 500)
    df = _frame(spark, x, _target(plain, codes, 0, 500))
    one, _ = fit_binned_forest(df, "f", "y", "guess", x.shape[1], 3, 6, 1, GROUPS)
    two, _ = fit_binned_forest(df, "f", "y", "guess", x.shape[1], 3, 6, 1)
    for a, b in zip(one.trees, two.trees):
        assert a.feature.tolist() == b.feature.tolist() and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)
