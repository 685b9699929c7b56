"""Extremely randomised trees, grown level by level over all rows.

Every node of every tree has its own candidates and cuts. A level takes two passes: the first
finds, for each open node and candidate feature, the least and greatest value among the
node's rows; between them a cut is drawn, from a seed, the tree and the node alone. The
second sums up what lies on the left of each candidate's cut, and the cut of the best
decrease in impurity (Gini, or variance) splits the node. Candidates are a random draw of
features without those that are constant in the node: the square root of the number of
features for classes, all for numbers. A node of one row, of one value of the target, or of
constant candidates is a leaf. Trees see all rows, without resampling.

Trees are the model and live on the driver, like any forest; what a pass sends there is a few
numbers per open node and candidate. A pass serves as many open nodes, of all trees, as fit
into ``LEVEL_BYTES``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.blocks import added, gather

#: bytes that the statistics of one pass may take in a task and on the driver; a task holds a few
#: copies of them
LEVEL_BYTES = 16_000_000
#: features that are looked at per wanted candidate, as some may be constant in a node
TRIES = 4
#: features of a row are read together where this many times those tried are as many
WHOLE_ROWS = 3


@dataclass
class Tree:
    """Nodes in order of birth; a leaf has feature -1. ``value``: class shares, or the mean."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), "i8")
        values, width = x.ravel(), x.shape[1]
        inner, node = np.arange(len(x)), at
        while True:  # rows that have reached a leaf are not looked at again
            feature = self.feature.take(node)
            going = np.flatnonzero(feature >= 0)
            if len(going) < len(node):
                inner, node, feature = inner.take(going), node.take(going), feature.take(going)
            if not len(inner):
                return at
            right = values.take(inner * width + feature) > self.cut.take(node)
            node = self.left.take(node) + right
            at[inner] = node


class _Growing:
    """A tree while it grows; the right child of a node follows its left one."""

    def __init__(self, number: int):
        self.number = number
        self.feature, self.cut, self.left = [-1], [0.0], [-1]
        self.total: list[np.ndarray | None] = [None]
        self.open = [0]

    def frozen(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.zeros((len(self.feature), 1)))


def _draw(seed: int, tree: int, node: int) -> np.random.Generator:
    return np.random.default_rng((seed, tree, node))


def _impurity(total: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini impurity, or times variance, along the last axis of statistics."""
    if classes:
        n = total.sum(-1)
        return n - (total * total).sum(-1) / np.maximum(n, 1e-300)
    n = np.maximum(total[..., 0], 1e-300)
    return np.maximum(total[..., 2] - total[..., 1] ** 2 / n, 0.0)


def _sides(y: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y.astype("i8")] = 1.0
        return out
    return np.stack([np.ones(len(y)), y, y * y], 1)


def values_of(stats: np.ndarray, classes: int) -> np.ndarray:
    """Class shares, or means, of nodes by their statistics."""
    return stats / np.maximum(stats.sum(1, keepdims=True), 1e-300) if classes else (stats[:, 1] / np.maximum(stats[:, 0], 1e-300))[:, None]


def _place(open_nodes: list[int], size: int) -> np.ndarray:
    place = np.full(size, -1, "i8")
    place[open_nodes] = np.arange(len(open_nodes))
    return place


def _grouped(node: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of node, the nodes that have rows and where theirs begin."""
    held = np.flatnonzero(node >= 0)  # without rows in finished nodes
    node = node.take(held)
    # short numbers are sorted by radix
    order = np.argsort(node.astype("i2") if many <= 32_767 else node, kind="stable")
    sorted_nodes, order = node.take(order), held.take(order)
    first = np.flatnonzero(np.diff(sorted_nodes, prepend=-1))
    return order, sorted_nodes[first], first


def _looked_up(x: np.ndarray, order: np.ndarray, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows in order of node, the values of their node's features."""
    at = np.repeat(features, np.diff(first, append=len(order)), 0)
    at += (order * x.shape[1])[:, None]
    return x.ravel().take(at)


def _ranges(trees: list[Tree], places: list[np.ndarray], tried: list[np.ndarray]):
    def found(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out = []
        for tree, place, features in zip(trees, places, tried):
            low, high = np.full(features.shape, np.inf), np.full(features.shape, -np.inf)
            order, nodes, first = _grouped(place[tree.leaves(x)], len(features))
            if len(order):
                tried_here = features[nodes]
                if WHOLE_ROWS * features.shape[1] >= x.shape[1]:
                    # most features are tried: those of all of a row are faster found than single ones
                    rows = x.take(order, 0)
                    low[nodes] = np.take_along_axis(np.minimum.reduceat(rows, first, 0), tried_here, 1)
                    high[nodes] = np.take_along_axis(np.maximum.reduceat(rows, first, 0), tried_here, 1)
                else:
                    values = _looked_up(x, order, tried_here, first)
                    low[nodes], high[nodes] = np.minimum.reduceat(values, first, 0), np.maximum.reduceat(values, first, 0)
            out += [low, high]
        return out

    return found


def _widened(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [(np.minimum, np.maximum)[i % 2](x, y) for i, (x, y) in enumerate(zip(a, b))]


def _lefts(trees: list[Tree], places: list[np.ndarray], chosen: list[np.ndarray], cuts: list[np.ndarray], classes: int):
    def found(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out, sides = [], _sides(y, classes)
        for tree, place, features, cut in zip(trees, places, chosen, cuts):
            left = np.zeros((*features.shape, sides.shape[1]))
            order, nodes, first = _grouped(place[tree.leaves(x)], len(features))
            if len(order):
                goes = _looked_up(x, order, features[nodes], first) <= np.repeat(cut[nodes], np.diff(first, append=len(order)), 0)
                of_rows = sides.take(order, 0)
                for side in range(sides.shape[1]):
                    left[nodes, :, side] = np.add.reduceat(goes * of_rows[:, side, None], first, 0)
            out.append(left)
        return out

    return found


def _totals(classes: int):
    def found(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [_sides(y, classes).sum(0)]

    return found


def _batches(growing: list[_Growing], nodes: int):
    """Open nodes of trees, so many at a time."""
    batch, room = [], nodes
    for tree in growing:
        first = 0
        while first < len(tree.open):
            part = tree.open[first : first + room]
            batch.append((tree, part))
            first, room = first + len(part), room - len(part)
            if not room:
                yield batch
                batch, room = [], nodes
    if batch:
        yield batch


def _split(tree: _Growing, nodes: list[int], features, cut, left, classes: int, born: list[int], gone: np.ndarray) -> None:
    """Split nodes by their best candidates."""
    parent = np.stack([tree.total[n] for n in nodes])
    right = parent[:, None, :] - left
    gain = _impurity(parent, classes)[:, None] - (_impurity(left, classes) + _impurity(right, classes))
    gain = np.where(np.isfinite(cut), gain, -np.inf)
    best = gain.argmax(1)
    for i, node in enumerate(nodes):
        k = best[i]
        if gain[i, k] == -np.inf:
            continue  # all candidates are constant
        tree.feature[node], tree.cut[node], tree.left[node] = int(features[i, k]), float(cut[i, k]), len(tree.feature)
        gone[features[i, k]] += max(float(gain[i, k]), 0.0)
        for side in (left[i, k], right[i, k]):
            born.append(len(tree.feature))
            tree.feature.append(-1)
            tree.cut.append(0.0)
            tree.left.append(-1)
            tree.total.append(side)


def grow(blocks: DataFrame, width: int, classes: int, numbers: list[int], depth: int, candidates: int, seed: int) -> tuple[list[Tree], np.ndarray]:
    """The trees of these numbers, and the impurity that each feature took away."""
    gone = np.zeros(width)
    total = gather(blocks, _totals(classes), added)
    growing = [_Growing(t) for t in numbers]
    for tree in growing:
        tree.total[0] = total[0]
    tries = min(width, max(TRIES * candidates, candidates))
    node_bytes = 8 * max(2 * tries, candidates * (classes or 3))
    for _ in range(depth):
        for tree in growing:
            tree.open = [n for n in tree.open if _impurity(tree.total[n], classes) > 1e-12 * max(1.0, abs(tree.total[n]).max())]
        if not any(t.open for t in growing):
            break
        born: dict[int, list[int]] = {t.number: [] for t in growing}
        frozen = {t.number: t.frozen() for t in growing}
        for batch in list(_batches(growing, max(1, LEVEL_BYTES // node_bytes))):
            trees = [frozen[t.number] for t, _ in batch]
            places = [_place(nodes, len(tree.feature)) for tree, (_, nodes) in zip(trees, batch)]
            draws = [[_draw(seed, t.number, n) for n in nodes] for t, nodes in batch]
            tried = [np.stack([d.permutation(width)[:tries] for d in own]) for own in draws]
            spans = gather(blocks, _ranges(trees, places, tried), _widened)
            chosen, cuts = [], []
            for i, own in enumerate(draws):
                low, high = spans[2 * i], spans[2 * i + 1]
                # candidates are the first that vary
                order = np.argsort(~(high > low), axis=1, kind="stable")[:, :candidates]
                features, a, b = (np.take_along_axis(z, order, 1) for z in (tried[i], low, high))
                cut = a + np.stack([d.random(candidates) for d in own]) * (b - a)
                chosen.append(features)
                cuts.append(np.where(b > a, np.where(cut < b, cut, a), np.inf))
            lefts = gather(blocks, _lefts(trees, places, chosen, cuts, classes), added)
            for (tree, nodes), features, cut, left in zip(batch, chosen, cuts, lefts):
                _split(tree, nodes, features, cut, left, classes, born[tree.number], gone)
        for tree in growing:
            tree.open = born[tree.number]
    out = []
    for tree in growing:
        out.append(Tree(np.array(tree.feature), np.array(tree.cut), np.array(tree.left), values_of(np.stack(tree.total), classes)))
    return out, gone


class RandomTrees(Transformer, MLReadable, MLWritable):
    """Mean of the trees' class shares (the class of the greatest, ties to the smaller) or values."""

    features = Param(Params._dummy(), "features", "column of vectors", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of predictions", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)

    def __init__(self, features="features", output="prediction", classes=0, trees: list[Tree] | None = None):
        super().__init__()
        self._set(features=features, output=output, classes=classes)
        self.trees = trees or []

    def copy(self, extra=None):
        other = super().copy(extra)
        other.trees = self.trees
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        shared = dataset.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def predicted(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            x, total = np.stack(vectors.to_numpy()).astype("f8"), 0.0
            for tree in shared.value:
                total = total + tree.value[tree.leaves(x)]
            return pd.Series(total.argmax(1).astype("f8") if classes else total[:, 0] / len(shared.value))

        return dataset.withColumn(self.getOrDefault(self.output), predicted(vector_to_array(self.getOrDefault(self.features))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: RandomTrees):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        rows = [
            (i, t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.value.shape[1], t.value.ravel().tolist())
            for i, t in enumerate(self.stage.trees)
        ]
        schema = "tree int, feature array<int>, cut array<double>, left array<int>, width int, value array<double>"
        self.sparkSession.createDataFrame(rows, schema).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> RandomTrees:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()
        trees = [
            Tree(np.array(r["feature"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["value"]).reshape(-1, r["width"])) for r in rows
        ]
        stage = RandomTrees(trees=trees)
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        return stage
