"""Kernel machines with a radial basis: margin classifier and epsilon-insensitive regression.

The kernel is ``exp(-gamma |x - y|^2)``. Landmarks, learned by k-means from a sample, or all
rows where they are few, give each row the coordinates ``K(x, L) K(L, L)^(-1/2)`` (Nystroem's
map): products of these are the kernel itself between landmarks, and near it elsewhere. There
the machine is a linear one, with the same objective,

    |w|^2 / 2 + C sum of losses,

where the loss is ``max(0, 1 - y f)`` for classes (each against the rest) and
``max(0, |y - f| - epsilon)`` for numbers, and no cost on the intercept. It is solved by
Newton's method on losses rounded off at their corner, ever more sharply; each step adds up
gradients and curvatures over all rows, in tasks. Probabilities come from Platt's sigmoid of
``f``, fitted to a histogram of the training rows' values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.blocks import added, check_width, gather, packed

C, EPSILON = 1.0, 0.1
#: rows per landmark that landmarks are learned from
SAMPLED = 64
#: rounding of the losses' corner, step by step
ROUNDINGS = (1.0, 0.1, 0.01)
#: steps of Newton's method per rounding at most
STEPS = 12
#: machines (one per class) that are solved at once
AT_ONCE = 8
#: bins, up to values of this size, that sigmoids are fitted to
BINS, FAR = 4096, 8.0


@dataclass
class Machine:
    """Landmarks, the map's matrix, and per machine weights, the intercept last, and sigmoids."""

    landmarks: np.ndarray
    lift: np.ndarray
    gamma: float
    weights: np.ndarray
    sigmoids: np.ndarray

    def __post_init__(self) -> None:
        # products round by how a matrix lies in memory, so that it lies as it does when read again
        for name in _PARTS:
            setattr(self, name, np.ascontiguousarray(getattr(self, name)))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return lifted(x, self.landmarks, self.lift, self.gamma)

    def values(self, x: np.ndarray) -> np.ndarray:
        """A column per machine."""
        return self.coordinates(x) @ self.weights[:, :-1].T + self.weights[:, -1]

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Of each class: the sigmoids of two classes' one machine, or of one machine each, made to
        add up to one."""
        p = 1.0 / (1.0 + np.exp(np.clip(self.sigmoids[:, 0] * values + self.sigmoids[:, 1], -500, 500)))
        if values.shape[1] == 1:
            return np.concatenate([1.0 - p, p], 1)
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def lifted(x: np.ndarray, landmarks: np.ndarray, lift: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2.0 * (x @ landmarks.T)
    return np.exp(-gamma * np.maximum(d, 0.0)) @ lift


def kernel_width(df: DataFrame, column: str) -> tuple[float, int]:
    """``1 / (p * variance of all entries)`` and the vector length p."""
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s")).first()["s"]
    mean, variance, n = row["mean"].toArray(), row["variance"].toArray(), row["count"]
    within = variance * (n - 1) / n if n > 1 else variance * 0
    overall = float(np.mean(within + (mean - mean.mean()) ** 2))
    width = len(mean)
    return (1.0 / (width * overall) if overall > 0 else 1.0), width


def landmarks_of(frame: DataFrame, column: str, rows: int, count: int, seed: int) -> np.ndarray:
    """Distinct landmarks: all rows where these are few, else centres of about ``SAMPLED`` rows each."""
    vectors = frame.select(F.col(column).alias("v"))
    if rows <= count:
        return np.unique(np.stack([r["v"].toArray() for r in vectors.collect()]), axis=0)
    if rows > SAMPLED * count:
        vectors = vectors.filter(F.pmod(F.xxhash64(vector_to_array("v"), F.lit(seed)), F.lit(rows)) < SAMPLED * count)
    fitted = KMeans(k=count, featuresCol="v", maxIter=10, initMode="random", seed=seed).fit(vectors)
    return np.unique(np.stack(fitted.clusterCenters()), axis=0)


def lift_of(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """``K^(-1/2)`` of the landmarks, without directions of hardly any length."""
    kernel = lifted(landmarks, landmarks, np.eye(len(landmarks)), gamma)
    size, direction = np.linalg.eigh((kernel + kernel.T) / 2)
    used = size > 1e-10 * size.max()
    return direction[:, used] / np.sqrt(size[used])


# -- losses --------------------------------------------------------------------------


def _rounded(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, slope and curvature of ``max(0, z)`` with its corner rounded off over ``width``."""
    inside = np.clip(z, 0.0, width)
    value = inside * inside / (2 * width) + np.maximum(z - width, 0.0)
    return value, inside / width, ((z > 0) & (z <= width)) / width


def _losses(f: np.ndarray, y: np.ndarray, regression: bool, width: float):
    """Per row and machine: loss, and its slope and curvature in ``f``."""
    if regression:
        r = f - y
        value, slope, curve = _rounded(np.abs(r) - EPSILON, width)
        return value, slope * np.sign(r), curve
    value, slope, curve = _rounded(1.0 - y * f, width)
    return value, -y * slope, curve


def _targets(y: np.ndarray, machines: list[int] | None) -> np.ndarray:
    """Numbers as they are; classes as 1 for a machine's own and -1 for others."""
    return y[:, None] if machines is None else np.where(y[:, None] == np.array(machines)[None, :], 1.0, -1.0)


def _solve(blocks: DataFrame, coordinates, width: int, machines: list[int] | None, weights: np.ndarray) -> np.ndarray:
    """Weights (a row per machine) of the least objective."""
    regression = machines is None
    penalty = np.append(np.ones(width), 0.0)

    def curvature(w: np.ndarray, rounding: float):
        def found(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            z = np.c_[coordinates(x), np.ones(len(x))]
            loss, slope, curve = _losses(z @ w.T, _targets(y, machines), regression, rounding)
            return [loss.sum(0), slope.T @ z, np.stack([(z * c[:, None]).T @ z for c in curve.T]), np.array([len(x)])]

        return found

    def along(w: np.ndarray, step: np.ndarray, rounding: float, lengths: np.ndarray):
        def found(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            z = np.c_[coordinates(x), np.ones(len(x))]
            f, g, t = z @ w.T, z @ step.T, _targets(y, machines)
            return [np.stack([_losses(f + s * g, t, regression, rounding)[0].sum(0) for s in lengths])]

        return found

    def cost(w: np.ndarray, loss: np.ndarray) -> np.ndarray:
        return 0.5 * (w * w * penalty).sum(1) + C * loss

    lengths = np.concatenate([[4.0, 2.0], 0.5 ** np.arange(12), [0.0]])
    steadied = np.zeros(width + 1)  # where no row is at the corner, nothing bends in the intercept
    for rounding in ROUNDINGS:
        for _ in range(STEPS):
            loss, slope, curve, rows = gather(blocks, curvature(weights, rounding), added)
            slope = C * slope + weights * penalty
            steadied[-1] = 1e-3 * C * rows[0]
            step = np.stack([-np.linalg.solve(C * c + np.diag(penalty + steadied), s) for c, s in zip(curve, slope)])
            (losses,) = gather(blocks, along(weights, step, rounding, lengths), added)
            costs = np.stack([cost(weights + s * step, row) for s, row in zip(lengths, losses)])
            before = cost(weights, loss)
            best = costs.argmin(0)
            weights = weights + lengths[best][:, None] * step
            if (before - costs.min(0) <= 1e-7 * np.maximum(1.0, np.abs(before))).all():
                break
    return weights


def _platt(right: np.ndarray, wrong: np.ndarray, middle: np.ndarray) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + exp(a f + b))`` fitted to counts of values of a class and of others."""
    n, m = right.sum(), wrong.sum()
    high, low = (n + 1) / (n + 2), 1 / (m + 2)
    a, b = 0.0, float(np.log((m + 1) / (n + 1)))
    target, many = right * high + wrong * low, right + wrong
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(np.clip(a * middle + b, -500, 500)))
        off = target - many * p  # slope in a f + b
        c = many * p * (1 - p) + 1e-12
        hessian = np.array([[(c * middle**2).sum() + 1e-9, (c * middle).sum()], [(c * middle).sum(), c.sum() + 1e-9]])
        step = np.linalg.solve(hessian, [(off * middle).sum(), off.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def fit_machine(frame: DataFrame, features: str, label: str, classes: int, components: int, seed: int) -> Machine:
    """``classes`` is 0 for numbers; two classes have one machine."""
    gamma, width = kernel_width(frame, features)
    check_width(width, "a kernel machine")
    blocks = packed(frame, features, label)
    rows = blocks.agg(F.sum("n")).first()[0]
    landmarks = landmarks_of(frame, features, rows, components, seed)
    lift = lift_of(landmarks, gamma)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return lifted(x, landmarks, lift, gamma)

    size = lift.shape[1]
    if not classes:
        start = np.zeros((1, size + 1))
        start[0, -1] = frame.agg(F.avg(label)).first()[0]
        return Machine(landmarks, lift, gamma, _solve(blocks, coordinates, size, None, start), np.zeros((1, 2)))
    own = [1] if classes == 2 else list(range(classes))
    weights, sigmoids = [], []
    edges = np.linspace(-FAR, FAR, BINS + 1)
    for first in range(0, len(own), AT_ONCE):
        machines = own[first : first + AT_ONCE]
        solved = _solve(blocks, coordinates, size, machines, np.zeros((len(machines), size + 1)))
        weights.append(solved)

        def counted(x: np.ndarray, y: np.ndarray, solved=solved, machines=machines) -> list[np.ndarray]:
            f = np.c_[coordinates(x), np.ones(len(x))] @ solved.T
            t, out = _targets(y, machines), []
            for k in range(len(machines)):
                place = np.clip(np.searchsorted(edges, f[:, k], side="right") - 1, 0, BINS - 1)
                out += [np.bincount(place[t[:, k] > 0], minlength=BINS), np.bincount(place[t[:, k] < 0], minlength=BINS)]
            return out

        counts = gather(blocks, counted, added)
        middle = (edges[:-1] + edges[1:]) / 2
        sigmoids += [_platt(counts[2 * k], counts[2 * k + 1], middle) for k in range(len(machines))]
    return Machine(landmarks, lift, gamma, np.concatenate(weights), np.array(sigmoids))


class KernelMachine(Transformer, MLReadable, MLWritable):
    """Predictions of a :class:`Machine`; for classes also ``probability``, an array by label."""

    features = Param(Params._dummy(), "features", "column of vectors", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of predictions", TypeConverters.toString)
    probability = Param(Params._dummy(), "probability", "column of class probabilities", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)

    def __init__(self, features="features", output="prediction", probability="probability", classes=0, machine: Machine | None = None):
        super().__init__()
        self._set(features=features, output=output, probability=probability, classes=classes)
        self.machine = machine

    def copy(self, extra=None):
        other = super().copy(extra)
        other.machine = self.machine
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        shared = dataset.sparkSession.sparkContext.broadcast(self.machine)

        @F.pandas_udf("struct<prediction double, probability array<double>>")
        def predicted(vectors: pd.Series) -> pd.DataFrame:
            if not len(vectors):
                return pd.DataFrame({"prediction": pd.Series([], dtype="float64"), "probability": pd.Series([], dtype=object)})
            f = shared.value.values(np.stack(vectors.to_numpy()).astype("f8"))
            if not classes:
                return pd.DataFrame({"prediction": f[:, 0], "probability": [None] * len(f)})
            label = (f[:, 0] > 0).astype("f8") if classes == 2 else f.argmax(1).astype("f8")
            return pd.DataFrame({"prediction": label, "probability": list(shared.value.probabilities(f))})

        out = dataset.withColumn("_machine", predicted(vector_to_array(self.getOrDefault(self.features))))
        out = out.withColumn(self.getOrDefault(self.output), F.col("_machine.prediction"))
        if classes:
            out = out.withColumn(self.getOrDefault(self.probability), F.col("_machine.probability"))
        return out.drop("_machine")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_PARTS = ("landmarks", "lift", "weights", "sigmoids")


class _Writer(MLWriter):
    def __init__(self, stage: KernelMachine):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        machine = self.stage.machine
        rows = [(name, row, values.tolist()) for name in _PARTS for row, values in enumerate(getattr(machine, name))]
        rows.append(("gamma", 0, [machine.gamma]))
        self.sparkSession.createDataFrame(rows, "part string, row int, numbers array<double>").write.parquet(f"{path}/machine")


class _Reader(MLReader):
    def load(self, path: str) -> KernelMachine:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts: dict[str, list] = {}
        for r in self.sparkSession.read.parquet(f"{path}/machine").orderBy("part", "row").collect():
            parts.setdefault(r["part"], []).append(r["numbers"])
        arrays = {name: np.array(parts[name]) for name in _PARTS}
        stage = KernelMachine(machine=Machine(gamma=parts["gamma"][0][0], **arrays))
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        return stage
