import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tablewright.operators import random_trees, row_trees
from tablewright.operators.blocks import packed
from tablewright.operators.row_trees import Plain, TightRows, fit_random_trees, grow_tree

GROUPS = [4, 1, 3]


def _mixed(seed, n):
    """Two plain features and three groups, one of a single feature; some rows have no 1 in a group."""
    draw = np.random.default_rng(seed)
    plain = [draw.normal(size=n), draw.integers(0, 6, n) / 3.0]
    codes = [draw.integers(0, size + 1, n) for size in GROUPS]
    hot = [np.eye(size + 1)[code][:, :size] for size, code in zip(GROUPS, codes)]
    return plain, codes, np.c_[np.stack(plain, 1), *hot]


def _frame(spark, x, y, parts=5):
    rows = [(Vectors.sparse(x.shape[1], [(i, float(v)) for i, v in enumerate(a) if v]), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["f", "y"]).repartition(parts)


def _target(plain, codes, classes, n):
    return (codes[0] + (plain[0] > 0.3) + np.arange(n) % 2) % 3 if classes else np.round(8 * plain[0]) + 3 * codes[2] + np.arange(n) % 5


@pytest.mark.parametrize("classes", [3, 0])
@pytest.mark.parametrize("few,step,level_bytes", [(1 << 16, 1 << 17, 16_000_000), (0, 7, 600), (10, 50, 3_000)])
def test_trees_are_those_of_passes(spark, monkeypatch, classes, few, step, level_bytes):
    """Node by node, wherever rows and nodes are parted, and whether values are listed or not."""
    monkeypatch.setattr(row_trees, "FEW", few)
    monkeypatch.setattr(row_trees, "STEP", step)
    monkeypatch.setattr(row_trees, "LEVEL_BYTES", level_bytes)
    plain, codes, x = _mixed(2, 300)
    y = _target(plain, codes, classes, 300)
    candidates = 3 if classes else x.shape[1]
    want, gone = random_trees.grow(packed(_frame(spark, x, y), "f", "y"), x.shape[1], classes, [0, 1, 2], 9, candidates, 42)
    data = TightRows([Plain.of(c) for c in plain], [c.astype("u1") for c in codes], GROUPS, y.astype("u1") if classes else y).sorted()
    found = [grow_tree(data, classes, number, 9, candidates, 42) for number in range(3)]
    for (one, _), two in zip(found, want):
        assert one.feature.tolist() == two.feature.tolist() and one.left.tolist() == two.left.tolist()
        assert np.allclose(one.cut, two.cut, atol=0) and np.allclose(one.value, two.value)
    assert np.allclose(sum(g for _, g in found), gone)


@pytest.mark.parametrize("classes", [3, 0])
def test_no_pass_over_the_rows_serves_a_level(spark, monkeypatch, classes):
    plain, codes, x = _mixed(3, 400)
    df = _frame(spark, x, _target(plain, codes, classes, 400))
    monkeypatch.setattr(row_trees, "SHARED_BYTES", 0)
    passes, importances = fit_random_trees(df, "f", "y", "guess", x.shape[1], classes, 4, 8, 42, GROUPS)
    monkeypatch.undo()
    monkeypatch.setattr(random_trees, "gather", None)
    shared, same = fit_random_trees(df, "f", "y", "guess", x.shape[1], classes, 4, 8, 42, GROUPS)
    assert [t.feature.tolist() for t in shared.trees] == [t.feature.tolist() for t in passes.trees]
    assert np.allclose(importances, same)
    one, two = ([r[0] for r in m.transform(df).orderBy("f", "y").select("guess").collect()] for m in (shared, passes))
    assert np.allclose(one, two)


def test_rows_without_plain_features_or_groups(spark):
    draw = np.random.default_rng(4)
    code, values = draw.integers(0, 3, 200), draw.normal(size=(200, 2))
    hot = _frame(spark, np.eye(4)[code][:, :3], code == 1)
    forest, importances = fit_random_trees(hot, "f", "y", "guess", 3, 2, 3, 5, 1, [3])
    assert forest.transform(hot).filter("guess != y").isEmpty() and importances[1] > 0
    plain = _frame(spark, values, values[:, 0] > 0)
    assert fit_random_trees(plain, "f", "y", "guess", 2, 2, 9, 30, 1)[0].transform(plain).filter("guess != y").isEmpty()
    alike = _frame(spark, np.ones((20, 2)), np.arange(20) % 2)
    assert [len(t.feature) for t in fit_random_trees(alike, "f", "y", "guess", 2, 2, 2, 5, 1)[0].trees] == [1, 1]
