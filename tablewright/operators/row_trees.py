"""Random trees grown from all rows within one task.

The trees are those of ``random_trees.grow``, node by node: the same draws for each node, the same
cuts, the same best candidate. But where the rows, kept tight, are few enough to be shared
(``SHARED_BYTES``), every task has them all, and whole trees are dealt out over the tasks, so that
no pass over the data serves a single level and no row walks down from the root again. Where they
are not, trees grow by passes over all rows.

Rows are kept tight in two ways. Plain features are columns of doubles, or of places among their
values where these are few. A group of features of which at most one is 1 and all others are 0, as
of the categories of a column, is one number per row: which one it is. What a group's rows add up
to, per category, tells the ranges and sums of all its features at once.

A tree keeps the numbers of the rows in its open nodes, in order of node. Sums are held for as many
nodes at a time as fit into ``LEVEL_BYTES``, and rows are read ``STEP`` at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.blocks import check_width, packed
from tablewright.operators.random_trees import TRIES, RandomTrees, Tree, _draw, _impurity, grow, values_of
from tablewright.session import ensure_checkpoint_dir

#: bytes that the sums of a tree's open nodes may take at a time, and rows that are read at a time
LEVEL_BYTES, STEP = 16_000_000, 1 << 17
#: bytes of tight rows up to which every task may hold them all
SHARED_BYTES = 256_000_000
#: most plain features, and numbers that a node's sums hold, as these are kept for all features
WIDEST, SUMS = 256, 1 << 16
#: a column of this many values is kept as places among them
FEW = 1 << 16


@dataclass
class Plain:
    """A feature's column: doubles, or places in ``values``, which are in order."""

    column: np.ndarray
    values: np.ndarray | None = None

    @classmethod
    def of(cls, column: np.ndarray) -> Plain:
        if len(np.unique(column[: 2 * FEW])) <= FEW:
            values = np.unique(column)
            if len(values) <= FEW:
                return cls(np.searchsorted(values, column).astype("u1" if len(values) <= 256 else "u2"), values)
        return cls(column)

    def real(self, found: np.ndarray) -> np.ndarray:
        return found if self.values is None else self.values[found]

    def limits(self, cuts: np.ndarray) -> np.ndarray:
        """What the column is to be compared with; no cut lies below the least value."""
        return cuts if self.values is None else (np.searchsorted(self.values, cuts, "right") - 1).astype(self.column.dtype)


@dataclass
class TightRows:
    """``codes``: of each group, the place of the feature that is 1, or the group's size where none
    is; ``groups``: their sizes."""

    plain: list[Plain]
    codes: list[np.ndarray]
    groups: list[int]
    y: np.ndarray

    @property
    def width(self) -> int:
        return len(self.plain) + sum(self.groups)

    def sorted(self) -> TightRows:
        """Rows that agree in their short columns next to each other, so that those of a node lie in runs."""
        places = [(len(p.values), p.column) for p in self.plain if p.values is not None]
        short = sorted([*places, *zip(self.groups, self.codes)], key=lambda c: -c[0])
        if not short:
            return self
        order = np.lexsort([column for _, column in short])
        plain = [Plain(p.column[order], p.values) for p in self.plain]
        return TightRows(plain, [c[order] for c in self.codes], self.groups, self.y[order])


class Level:
    """Open nodes of a level: rows in order of node, how many of them each has, its sums and number."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, totals: np.ndarray, ids: np.ndarray):
        self.rows, self.sizes, self.totals, self.ids = rows, sizes, totals, ids

    def kept(self, keep: np.ndarray) -> Level:
        if keep.all():
            return self
        return Level(self.rows[np.repeat(keep, self.sizes)], self.sizes[keep], self.totals[keep], self.ids[keep])

    def parts(self, nodes: int) -> Iterator[Level]:
        ends = np.cumsum(self.sizes)
        for first in range(0, len(self.ids), nodes):
            span = slice(first, first + nodes)
            begin = ends[first] - self.sizes[first]
            yield Level(self.rows[begin : ends[span][-1]], self.sizes[span], self.totals[span], self.ids[span])


def steps(rows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, so many at a time: them, their node, the nodes that they are in and where those begin."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for start in range(0, len(rows), STEP):
        end = min(start + STEP, len(rows))
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(begins, end, "left")
        nodes = np.arange(first, last)
        begin = np.maximum(begins[first:last], start)
        many = np.minimum(ends[first:last], end) - begin
        yield rows[start:end], np.repeat(nodes, many), nodes, begin - start


def _summed(at: np.ndarray, y: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Sums of the rows' statistics by place."""
    if classes:
        return np.bincount(at * classes + y, minlength=size * classes).reshape(size, classes).astype("f8")
    return np.stack([np.bincount(at, w, size) for w in (None, y, y * y)], 1)


def _ones(data: TightRows, level: Level, classes: int) -> np.ndarray:
    """Of each node and feature of a group the sums of the rows in which it is 1."""
    m, stats = len(level.sizes), classes or 3
    hot = [np.zeros((m, size + 1, stats)) for size in data.groups]
    for rows, place, nodes, begin in steps(level.rows, level.sizes) if hot else ():
        base, many = nodes[0], len(nodes)
        y = data.y.take(rows)
        for sums, code, size in zip(hot, data.codes, data.groups):
            at = code.take(rows) if many == 1 else (place - base) * (size + 1) + code.take(rows)
            sums[base : base + many] += _summed(at, y, many * (size + 1), classes).reshape(many, size + 1, stats)
    return np.concatenate([sums[:, :-1] for sums in hot], 1) if hot else np.zeros((m, 0, stats))


def _wanted(varies: np.ndarray, tried: np.ndarray, p: int, candidates: int) -> np.ndarray:
    """Which plain features a node may choose: of those tried, the ones before which too few of a
    group are known to vary. ``varies``: of each node and feature of a group."""
    certain = np.zeros(tried.shape, bool)
    if varies.shape[1]:
        certain = (tried >= p) & np.take_along_axis(varies, np.maximum(tried - p, 0), 1)
    asked = (tried < p) & (np.cumsum(certain, 1) < candidates)
    out = np.zeros((len(tried), p), bool)
    node, k = np.nonzero(asked)
    out[node, tried[node, k]] = True
    return out


def _spans(data: TightRows, level: Level, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of the plain features that a node wants."""
    low, high = np.full(wanted.shape, np.inf), np.full(wanted.shape, -np.inf)
    for rows, place, nodes, begin in steps(level.rows, level.sizes) if wanted.any() else ():
        for j, plain in enumerate(data.plain):
            own = wanted[nodes, j]
            if not own.any():
                continue
            mine, first, of = rows, begin, nodes
            if not own.all():
                mine, many = rows[own[place - nodes[0]]], np.diff(begin, append=len(rows))[own]
                first, of = np.cumsum(many) - many, nodes[own]
            values = plain.column.take(mine)
            low[of, j] = np.minimum(low[of, j], plain.real(np.minimum.reduceat(values, first)))
            high[of, j] = np.maximum(high[of, j], plain.real(np.maximum.reduceat(values, first)))
    return low, high


def _lefts(data: TightRows, level: Level, classes: int, features: np.ndarray, cuts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of each node and candidate the sums of the rows up to its cut."""
    p = len(data.plain)
    group = np.maximum(features - p, 0)
    if ones.shape[1]:
        left = level.totals[:, None, :] - np.take_along_axis(ones, group[:, :, None], 1)  # all but the ones
    else:
        left = np.zeros((*features.shape, level.totals.shape[1]))
    left[features < p] = 0.0
    varies = np.isfinite(cuts)
    used = [(j, *np.nonzero((features == j) & varies)) for j in range(p)]
    used = [u for u in used if len(u[1])]
    has, limit = {}, {}
    for j, node, k in used:
        own = np.full(len(level.sizes), data.plain[j].values[0] if data.plain[j].values is not None else 0.0)
        own[node] = cuts[node, k]
        limit[j], has[j] = data.plain[j].limits(own), np.zeros(len(own), bool)
        has[j][node] = True
    for rows, place, nodes, begin in steps(level.rows, level.sizes) if used else ():
        base, many = nodes[0], len(nodes)
        for j, node, k in used:
            own = has[j][nodes]
            if not own.any():
                continue
            mine, at = rows, place
            if not own.all():
                some = own[place - base]
                mine, at = rows[some], place[some]
            goes = data.plain[j].column.take(mine) <= limit[j][at if many > 1 else base]
            sums = _summed(at[goes] - base, data.y.take(mine[goes]), many, classes)
            span = slice(np.searchsorted(node, base), np.searchsorted(node, base + many))
            left[node[span], k[span]] += sums[node[span] - base]
    return left


def parted(data: TightRows, level: Level, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of child, the left one first; and how many rows each left child has."""
    p, offsets = len(data.plain), len(data.plain) + np.cumsum([0, *data.groups])
    out, lefts = np.empty_like(level.rows), np.zeros(len(level.sizes), "i8")
    side = np.empty(len(level.rows), bool)
    at = 0
    for rows, place, nodes, begin in steps(level.rows, level.sizes):
        base, right = nodes[0], side[at : at + len(rows)]
        at += len(rows)
        mine = feature[nodes]
        chosen = np.unique(np.searchsorted(offsets, mine, "right"))  # 0: plain, else groups
        for kind in chosen:
            if kind == 0:
                for j in np.unique(mine[mine < p]):
                    own, plain = mine == j, data.plain[j]
                    limit = plain.limits(cut[nodes])
                    if own.all():
                        right[:] = plain.column.take(rows) > (limit[place - base] if len(nodes) > 1 else limit[0])
                    else:
                        some = own[place - base]
                        right[some] = plain.column.take(rows[some]) > limit[place[some] - base]
            else:
                first, last, code = offsets[kind - 1], offsets[kind], data.codes[kind - 1]
                own = (mine >= first) & (mine < last)
                if own.all():
                    right[:] = code.take(rows) == (feature[place] - first)
                else:
                    some = own[place - base]
                    right[some] = code.take(rows[some]) == (feature[place[some]] - first)
        lefts[nodes] += np.add.reduceat(~right, begin, dtype="i8")
    begins = np.cumsum(level.sizes) - level.sizes
    to_left, to_right = begins.copy(), begins + lefts  # where the next row of a side goes
    at = 0
    for rows, place, nodes, begin in steps(level.rows, level.sizes):
        right = side[at : at + len(rows)]
        at += len(rows)
        if len(nodes) == 1:
            a, b = rows[~right], rows[right]
            n = nodes[0]
            out[to_left[n] : to_left[n] + len(a)], out[to_right[n] : to_right[n] + len(b)] = a, b
            to_left[n] += len(a)
            to_right[n] += len(b)
            continue
        base = nodes[0]
        passed = np.cumsum(right)  # right ones up to each row
        before = passed[begin] - right[begin]
        rank = passed - before[place - base]
        order = np.arange(len(rows)) - begin[place - base]
        out[np.where(right, to_right[place] + rank - 1, to_left[place] + order - rank)] = rows
        gone = np.add.reduceat(right, begin, dtype="i8")
        to_right[nodes] += gone
        to_left[nodes] += np.diff(begin, append=len(rows)) - gone
    return out, lefts


def _chosen(
    data: TightRows, level: Level, classes: int, candidates: int, tries: int, seed: int, number: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the best split: feature (-1 where none varies), cut, sums of the left, decrease."""
    draws = [_draw(seed, number, int(n)) for n in level.ids]
    tried = np.stack([d.permutation(data.width)[:tries] for d in draws])
    shares = np.stack([d.random(candidates) for d in draws])
    ones, p = _ones(data, level, classes), len(data.plain)
    counts = ones.sum(2) if classes else ones[:, :, 0]
    full = counts == level.sizes[:, None]
    low, high = _spans(data, level, _wanted((counts > 0) & ~full, tried, p, candidates))
    low, high = (np.take_along_axis(np.concatenate(x, 1), tried, 1) for x in ((low, full), (high, counts > 0)))
    # candidates are the first that vary
    order = np.argsort(~(high > low), axis=1, kind="stable")[:, :candidates]
    features, a, b = (np.take_along_axis(z, order, 1) for z in (tried, low, high))
    with np.errstate(invalid="ignore"):
        cut = a + shares * (b - a)
        cuts = np.where(b > a, np.where(cut < b, cut, a), np.inf)
    left = _lefts(data, level, classes, features, cuts, ones)
    parent = level.totals
    gain = _impurity(parent, classes)[:, None] - (_impurity(left, classes) + _impurity(parent[:, None, :] - left, classes))
    gain = np.where(np.isfinite(cuts), gain, -np.inf)
    best = gain.argmax(1)[:, None]
    feature, cut, decrease = (np.take_along_axis(z, best, 1)[:, 0] for z in (features, cuts, gain))
    return np.where(decrease > -np.inf, feature, -1), cut, left[np.arange(len(left)), best[:, 0]], decrease


def grow_tree(data: TightRows, classes: int, number: int, depth: int, candidates: int, seed: int) -> tuple[Tree, np.ndarray]:
    """The tree of this number, and the impurity that each feature took away."""
    gone, tries = np.zeros(data.width), min(data.width, max(TRIES * candidates, candidates))
    sums = _summed(np.zeros(len(data.y), "i8"), data.y, 1, classes)
    level = Level(np.arange(len(data.y), dtype="i4"), np.array([len(data.y)]), sums, np.zeros(1, "i8"))
    room = max(1, LEVEL_BYTES // (8 * (classes or 3) * (data.width + len(data.groups))))
    born, levels = 1, []
    for left_over in range(depth, -1, -1):
        features, cuts, children = np.full(len(level.ids), -1), np.zeros(len(level.ids)), np.full(len(level.ids), -1)
        levels.append((features, cuts, children, level.totals))
        first = int(level.ids[0])
        level = level.kept(_impurity(level.totals, classes) > 1e-12 * np.maximum(1.0, np.abs(level.totals).max(1)))
        if not left_over or not len(level.ids):
            break
        found = [_chosen(data, part, classes, candidates, tries, seed, number) for part in level.parts(room)]
        feature, cut, left, decrease = (np.concatenate(x) for x in zip(*found))
        split = feature >= 0
        if not split.any():
            break
        level, feature, cut, left = level.kept(split), feature[split], cut[split], left[split]
        np.add.at(gone, feature, np.maximum(decrease[split], 0.0))
        here, many = level.ids - first, 2 * len(feature)
        features[here], cuts[here], children[here] = feature, cut, born + np.arange(0, many, 2)
        rows, lefts = parted(data, level, feature, cut)
        sizes = np.stack([lefts, level.sizes - lefts], 1).ravel()
        totals = np.stack([left, level.totals - left], 1).reshape(many, -1)
        level = Level(rows, sizes, totals, born + np.arange(many))
        born += many
    features, cuts, children, stats = (np.concatenate(x) for x in zip(*levels))
    return Tree(features, cuts, children, values_of(stats, classes)), gone


def tight_columns(features: str, width: int, groups: Sequence[int]) -> list:
    """``f0, f1, ...``: the plain features; ``g0, g1, ...``: of each group, which one is 1, or its size."""
    p = width - sum(groups)
    firsts = p + np.cumsum([0, *groups])
    array = vector_to_array(features)
    codes = []
    for i, size in enumerate(groups):
        place = F.array_position(F.slice(array, int(firsts[i]) + 1, size), F.lit(1.0)).cast("int")
        codes.append(F.when(place > 0, place - 1).otherwise(size).alias(f"g{i}"))
    return [*(F.get(array, F.lit(i)).alias(f"f{i}") for i in range(p)), *codes]


def _shared(frame: DataFrame, features: str, label: str, width: int, classes: int, groups: Sequence[int]) -> TightRows | None:
    """All rows, kept tight; None where they are too many."""
    p, small = width - sum(groups), ["u1" if size < 256 else "u2" for size in groups]
    if p > WIDEST or width * (classes or 3) > SUMS:
        return None
    ensure_checkpoint_dir(frame.sparkSession)
    names = [*(f"f{i}" for i in range(p)), *(f"g{i}" for i in range(len(groups))), "y"]
    kinds = ["f8"] * p + small + ["f8"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"n": [len(batch)], **{name: [batch[name].to_numpy(kind).tobytes()] for name, kind in zip(names, kinds)}})

    rows = frame.select(*tight_columns(features, width, groups), F.col(label).cast("double").alias("y"))
    blocks = rows.mapInPandas(pack, "n bigint, " + ", ".join(f"{name} binary" for name in names)).checkpoint()
    most = SHARED_BYTES // sum(np.dtype(kind).itemsize for kind in kinds)
    if not 0 < (blocks.agg(F.sum("n")).first()[0] or 0) <= min(most, np.iinfo("i4").max):
        return None
    found = blocks.toPandas()  # of a checked number of bytes
    columns = [np.frombuffer(b"".join(found.pop(name)), kind) for name, kind in zip(names, kinds)]
    y = columns.pop()
    if classes:
        y = y.astype("u1" if classes <= 256 else "u2")
    return TightRows([Plain.of(c) for c in columns[:p]], columns[p:], list(groups), y).sorted()


def _dealt_out(
    frame: DataFrame, data: TightRows, classes: int, trees: int, depth: int, candidates: int, seed: int
) -> tuple[list[Tree], np.ndarray]:
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast(data)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                tree, gone = grow_tree(shared.value, classes, int(number), depth, candidates, seed)
                parts = {"feature": tree.feature.astype("i4"), "cut": tree.cut, "left": tree.left.astype("i4"), "value": tree.value, "gone": gone}
                yield pd.DataFrame({"tree": [number], **{name: [part.tobytes()] for name, part in parts.items()}})

    schema = "tree bigint, feature binary, cut binary, left binary, value binary, gone binary"
    rows = spark.range(0, trees, 1, min(trees, 16 * spark.sparkContext.defaultParallelism)).mapInPandas(grown, schema).toPandas()
    shared.destroy()
    rows = rows.sort_values("tree")
    forest = [
        Tree(np.frombuffer(f, "i4"), np.frombuffer(c), np.frombuffer(a, "i4"), np.frombuffer(v).reshape(-1, classes or 1))
        for f, c, a, v in zip(rows["feature"], rows["cut"], rows["left"], rows["value"])
    ]
    return forest, sum(np.frombuffer(g) for g in rows["gone"])


def fit_random_trees(
    frame: DataFrame, features: str, label: str, output: str, width: int, classes: int, trees: int, depth: int, seed: int, groups: Sequence[int] = ()
) -> tuple[RandomTrees, list[float]]:
    """The forest and the importance of each feature (shares of impurity taken away). The last
    features are ``groups`` of so many each, of which at most one is 1 in a row and the others are 0."""
    check_width(width, "a forest of random trees")
    candidates = max(1, math.isqrt(width)) if classes else width
    data = _shared(frame, features, label, width, classes, groups)
    if data is None:
        grown, gone = grow(packed(frame, features, label), width, classes, list(range(trees)), depth, candidates, seed)
    else:
        grown, gone = _dealt_out(frame, data, classes, trees, depth, candidates, seed)
    total = gone.sum()
    return RandomTrees(features, output, classes, grown), [float(g) for g in (gone / total if total > 0 else gone)]
