"""Learners of this library against plain solutions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import inverted_file, kernel, random_trees
from tablewright.operators.blocks import added, gather, packed
from tablewright.operators.inverted_file import InvertedFile, best
from tablewright.operators.models import LIGHT, Settings
from tablewright.operators.neighbours import nearest
from tablewright.operators.training import train
from tablewright.sources.models import load_model, save_model


def frame_of(spark, x, y, parts=5):
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["f", "y"]).repartition(parts)


# -- sums over blocks ----------------------------------------------------------------


def test_sums_of_blocks(spark):
    x, y = np.random.default_rng(1).normal(size=(500, 3)), np.arange(500.0)
    for parts in (1, 40):
        blocks = packed(frame_of(spark, x, y, parts), "f", "y")
        total, square = gather(blocks, lambda a, b: [a.sum(0), a.T @ a], added)
        assert np.allclose(total, x.sum(0)) and np.allclose(square, x.T @ x)
    assert gather(blocks.limit(0), lambda a, b: [a.sum(0)], added) is None


# -- random trees --------------------------------------------------------------------


def plain_tree(x, y, classes, number, depth, candidates, seed):
    """The same tree grown by recursion over row sets, in order of level."""
    width, tries = x.shape[1], min(x.shape[1], max(4 * candidates, candidates))
    side = random_trees._sides(y, classes)
    nodes, level = {0: np.arange(len(y))}, [0]
    feature, cut, left = [-1], [0.0], [-1]
    for _ in range(depth):
        born = []
        for node in level:
            rows = nodes[node]
            total = side[rows].sum(0)
            if not random_trees._impurity(total, classes) > 1e-12 * max(1.0, abs(total).max()):
                continue
            draw = random_trees._draw(seed, number, node)
            tried = draw.permutation(width)[:tries]
            varying = [f for f in tried if x[rows, f].min() < x[rows, f].max()]
            options = (varying + [f for f in tried if f not in varying])[:candidates]
            shares, found = draw.random(candidates), []
            for f, share in zip(options, shares):
                low, high = x[rows, f].min(), x[rows, f].max()
                if low < high:
                    c = low + share * (high - low)
                    goes = x[rows, f] <= c
                    parts = [side[rows[goes]].sum(0), side[rows[~goes]].sum(0)]
                    found.append((random_trees._impurity(total, classes) - sum(random_trees._impurity(p, classes) for p in parts), f, c, goes))
            if not found:
                continue
            gain, f, c, goes = max(found, key=lambda z: z[0])
            feature[node], cut[node], left[node] = f, c, len(feature)
            for part in (rows[goes], rows[~goes]):
                nodes[len(feature)] = part
                born.append(len(feature))
                feature.append(-1), cut.append(0.0), left.append(-1)
        level = born
    return np.array(feature), np.array(cut), np.array(left), nodes


@pytest.mark.parametrize("classes,level_bytes", [(3, 64_000_000), (3, 600), (0, 64_000_000), (0, 900)])
def test_trees_are_the_plain_ones(spark, monkeypatch, classes, level_bytes):
    """Also where a pass has room for a few nodes only."""
    monkeypatch.setattr(random_trees, "LEVEL_BYTES", level_bytes)
    draw = np.random.default_rng(5)
    x = np.c_[draw.normal(size=(120, 3)), np.ones(120), draw.integers(0, 2, 120)]
    y = draw.integers(0, 3, 120).astype(float) if classes else np.round(x[:, 0] * 30 + 10 * draw.normal(size=120))
    y[:40] = y[0]  # a third of the rows alike
    blocks = packed(frame_of(spark, x, y), "f", "y")
    candidates = 2 if classes else 5
    trees, gone = random_trees.grow(blocks, 5, classes, [0, 1], 6, candidates, 42)
    for number, tree in enumerate(trees):
        feature, cut, left, nodes = plain_tree(x, y, classes, number, 6, candidates, 42)
        assert (tree.feature == feature).all() and np.allclose(tree.cut, cut) and (tree.left == left).all()
        leaves = tree.leaves(x)
        for node, rows in nodes.items():
            want = np.bincount(y[rows].astype(int), minlength=3) / len(rows) if classes else [y[rows].mean()]
            assert np.allclose(tree.value[node], want)
            if tree.feature[node] < 0:
                assert set(np.flatnonzero(leaves == node)) == set(rows)
    assert gone[3] == 0 and gone[0] > 0
    # every tree, and every node, has cuts of its own
    cuts = np.concatenate([t.cut[t.feature >= 0] for t in trees])
    split = np.concatenate([t.feature[t.feature >= 0] for t in trees])
    assert len(set(cuts[split != 4])) == (split != 4).sum()


def test_ranges_of_whole_rows_are_those_of_single_features(monkeypatch):
    draw = np.random.default_rng(6)
    x, y = draw.normal(size=(300, 6)), draw.normal(size=300)
    tree = random_trees.Tree(np.array([2, -1, -1]), np.array([0.1, 0.0, 0.0]), np.array([1, -1, -1]), np.zeros((3, 1)))
    place, tried = random_trees._place([2], 3), np.array([[4, 0, 5]])
    for share in (0, 3):
        monkeypatch.setattr(random_trees, "WHOLE_ROWS", share)
        low, high = random_trees._ranges([tree], [place], [tried])(x, y)
        rows = x[x[:, 2] > 0.1][:, [4, 0, 5]]
        assert (low[0] == rows.min(0)).all() and (high[0] == rows.max(0)).all()


def test_forest_learns_a_disc_and_keeps_when_saved(spark, tmp_path):
    draw = np.random.default_rng(3)
    a, b = draw.uniform(-1, 1, (2, 1500))
    rows = [(i, float(u), float(v), "in" if u * u + v * v < 0.5 else "out") for i, (u, v) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y string")
    result = train(df.drop("k").withColumn("k", F.monotonically_increasing_id()), "y", "extra_trees", key=["k"], settings=Settings(trees=20, forest_depth=10))
    assert result.metrics.first()["accuracy"] > 0.9
    importance = {r["feature"]: r["importance"] for r in result.importance.collect()}
    assert abs(sum(importance.values()) - 1) < 0.01 and min(importance["numeric__a"], importance["numeric__b"]) > 0.25
    back = load_model(spark, save_model(spark, result.model, str(tmp_path)))
    assert back.metadata()["fidelity"] == "exact"
    one, two = (m.pipeline.transform(df).select("k", "_prediction").orderBy("k").collect() for m in (result.model, back))
    assert one == two


# -- kernel machines -----------------------------------------------------------------


def rbf(x, z, gamma):
    return np.exp(-gamma * ((x[:, None] - z[None]) ** 2).sum(2))


def dual_classifier(k, y, c=1.0, rounds=4000):
    """Values at the rows by pairs of dual coefficients, changed while it helps."""
    alpha, n = np.zeros(len(y)), len(y)
    grad = -np.ones(n)
    q = k * y[:, None] * y[None]
    for _ in range(rounds):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < c)) | ((y > 0) & (alpha > 0))
        score = -y * grad
        i, j = np.where(up, score, -np.inf).argmax(), np.where(low, score, np.inf).argmin()
        if score[i] - score[j] < 1e-6:
            break
        step = (score[i] - score[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        most_i = c - alpha[i] if y[i] > 0 else alpha[i]
        most_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, most_i, most_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * (q[:, i] * y[i] - q[:, j] * y[j])
    return k @ (alpha * y) + (score[i] + score[j]) / 2


def test_classifier_is_the_exact_one_on_few_rows(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(90, 2))
    y = ((x**2).sum(1) < 1.2).astype(float)
    frame = frame_of(spark, x, y)
    machine = kernel.fit_machine(frame, "f", "y", 2, 256, 42)
    assert len(machine.landmarks) == 90
    assert np.isclose(machine.gamma, 1 / (2 * x.var()))
    f, want = machine.values(x)[:, 0], dual_classifier(rbf(x, x, machine.gamma), np.where(y > 0, 1.0, -1.0))
    assert np.abs(f - want).max() < 0.05
    p = machine.probabilities(machine.values(x))
    assert np.allclose(p.sum(1), 1) and ((p[:, 1] > 0.5) == (y > 0)).mean() > 0.9
    assert (np.argsort(f) == np.argsort(p[:, 1], kind="stable")).mean() > 0.9  # probabilities rise with the value


def test_regression_is_the_exact_one_on_few_rows(spark):
    draw = np.random.default_rng(4)
    x = draw.uniform(-2, 2, (70, 1))
    y = np.sin(2 * x[:, 0]) + 0.05 * draw.normal(size=70)
    machine = kernel.fit_machine(frame_of(spark, x, y), "f", "y", 0, 256, 42)
    k = rbf(x, x, machine.gamma)

    def cost(f_minus_b, b):
        w = np.linalg.lstsq(k, f_minus_b, rcond=1e-10)[0]
        return 0.5 * f_minus_b @ w + np.maximum(np.abs(f_minus_b + b - y) - 0.1, 0).sum()

    # the objective by slow subgradients on the dual coefficients, from many steps
    a, b, least = np.zeros(70), y.mean(), np.inf
    for t in range(30_000):
        f = k @ a + b
        g = np.sign(f - y) * (np.abs(f - y) > 0.1)
        least = min(least, 0.5 * a @ k @ a + np.maximum(np.abs(f - y) - 0.1, 0).sum())
        a, b = a - 0.5 / (t + 30) ** 0.7 * (a + g), b - 0.02 / (t + 30) ** 0.7 * g.sum()
    values = machine.values(x)[:, 0]
    bias = machine.weights[0, -1]
    assert cost(values - bias, bias) <= least * 1.02 + 1e-3
    assert np.abs(values - np.sin(2 * x[:, 0])).mean() < 0.12


@pytest.mark.parametrize("target", ["disc", "ring", "height"])
def test_machines_beat_the_constant_guess(spark, tmp_path, target):
    draw = np.random.default_rng(6)
    a, b = draw.uniform(-1, 1, (2, 2000))
    r = a * a + b * b
    rows = [(i, float(u), float(v), "in" if q < 0.6 else "out", "abc"[int(q * 1.49) if q < 2 else 2], float(q * 3)) for i, (u, v, q) in enumerate(zip(a, b, r))]
    df = spark.createDataFrame(rows, "k long, a double, b double, disc string, ring string, height double").select("k", "a", "b", target)
    few = Settings(components=60)
    result = train(df.select("a", "b", target), target, "svm", settings=few)
    row = result.metrics.first()
    common = df.groupBy(target).count().agg(F.max("count")).first()[0] / 2000
    assert (row["r2_score"] > 0.9) if target == "height" else (row["accuracy"] > max(common + 0.1, 0.9))
    back = load_model(spark, save_model(spark, result.model, str(tmp_path)))
    out = back.pipeline.transform(df)
    if target != "height":
        best_class = F.array_position("_probability", F.array_max("_probability")) - 1
        assert out.filter(best_class == F.col("_prediction")).count() > 1900
        assert out.filter(F.abs(F.aggregate("_probability", F.lit(0.0), lambda x, y: x + y) - 1) > 1e-9).isEmpty()
    assert out.select("k", "_prediction").orderBy("k").collect() == result.model.pipeline.transform(df).select("k", "_prediction").orderBy("k").collect()


# -- inverted file -------------------------------------------------------------------


def test_best_is_plain(spark):
    draw = np.random.default_rng(7)
    known = np.r_[np.repeat(draw.normal(size=(1, 4)), 30, 0), draw.normal(size=(200, 4))] + 1e4  # far from zero: products round
    asked, ids = np.r_[known[:2], draw.normal(size=(20, 4)) + 1e4], draw.permutation(230)
    row, place, square = best(asked, ids, known, 7)
    d = ((asked[:, None] - known[None]) ** 2).sum(2)
    want = [np.lexsort((ids, r))[:7] for r in d]
    assert (place.reshape(-1, 7) == np.array(want)).all() and np.allclose(square, np.take_along_axis(d, np.array(want), 1).ravel())


def spread(spark, seed, n, m):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 6)) * 6
    points = lambda count: centres[draw.integers(0, 12, count)] + draw.normal(size=(count, 6))
    known, asked = np.r_[np.zeros((n // 3, 6)), points(n)], np.r_[np.zeros((m // 3, 6)), points(m)]
    k = spark.createDataFrame([(i, float(i % 4), list(map(float, x))) for i, x in enumerate(known)], "id long, label double, vector array<double>")
    q = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(asked)], "id long, vector array<double>")
    d = ((asked[:, None] - known[None]) ** 2).sum(2)
    return k, q, [[int(i) for i in np.lexsort((np.arange(len(known)), r))[:5]] for r in d]


def test_inverted_file_is_exact_and_prunes(spark):
    k, q, want = spread(spark, 9, 3000, 400)
    lists = InvertedFile(k, 5, 4000, 6, 60)
    # of a crowd with equal vectors only the first matter, and every known row is in one list
    assert lists.rows.count() == lists.rows.select("id").distinct().count() == 3005
    found = {}
    for r in lists.search(q).orderBy("query_id", "distance", "neighbour_id").collect():
        found.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert [found[i] for i in range(len(want))] == want
    single = q.filter("id >= 133")
    first = single.withColumn("list", F.explode(lists._first()("vector")))
    rest = single.withColumn("list", F.explode(lists._rest(None)("vector", F.lit(4.0))))
    many = lists.rows.select("list").distinct().count()
    assert first.count() + rest.count() < 0.5 * single.count() * many


def test_blocks_of_queries_meet_packs_of_lists(spark, monkeypatch):
    """No copy of a query is dealt out per list, and many small packs and blocks give the same."""
    monkeypatch.setattr(inverted_file, "PACK_BYTES", 8 * 6 * 50)
    k, q, want = spread(spark, 11, 600, 90)
    lists = InvertedFile(k, 5, 800, 6, 20)
    assert lists.packs.count() > 4
    search = lists.search(q)
    plan = search._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    found = {}
    for r in search.orderBy("query_id", "distance", "neighbour_id").collect():
        found.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert [found[i] for i in range(len(want))] == want
    missing = k.limit(3).select(F.lit(None).cast("long").alias("id"), "vector").unionByName(q)
    assert lists.search(missing).filter("query_id IS NULL").count() == 5


def test_probes_bound_the_work_and_keep_the_recall(spark):
    k, q, want = spread(spark, 10, 3000, 300)
    found = nearest(k, q, 5, shared_bytes=0, block_rows=60, probes=6).collect()
    hits = len({(r["query_id"], r["neighbour_id"]) for r in found} & {(i, j) for i, row in enumerate(want) for j in row})
    assert hits >= 0.9 * sum(map(len, want))
    assert all(len([r for r in found if r["query_id"] == i]) == 5 for i in (0, 200))
