"""Forests for numbers, grown from counts of binned rows.

Each feature is cut at up to ``BINS - 1`` values: between all its values where these are few,
else at quantiles of all rows. Rows that agree in all bins and in the target are counted by
Spark. A tree sees every row as often as a Poisson draw of mean 1 says (a bootstrap of all rows),
and so the rows of one count as often as one draw with the count as its mean says: trees grown
from the counts are distributed as those grown from the rows, whatever the number of rows.

Where the counts are few enough to share (``SHARED_BYTES``), trees are dealt out over the tasks
and each is grown level by level: the cut that takes most variance away splits a node, and a node
is a leaf where no cut takes any (beyond rounding), or at the greatest depth. Where they are not
there is no such forest, and the caller takes a learner that reads all rows for each level.

Counts are kept tight: the features of a column's categories, of which at most one is 1, are one
number (see ``row_trees``). Trees grow from them as they are where a byte per feature would be over
``DENSE_BYTES``, so that also counts of nearly as many kinds of rows as there are rows fit.

Trees are the model and live on the driver, as ``RandomTrees``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.random_trees import RandomTrees, Tree
from tablewright.operators.row_trees import Level, Plain, TightRows, parted, steps, tight_columns
from tablewright.session import ensure_checkpoint_dir

BINS = 32
#: most features of rows that are binned, as bins are dense
WIDEST = 256
#: bytes of counts up to which every task may hold them all, and up to which with a byte per feature
SHARED_BYTES, DENSE_BYTES = 256_000_000, 32_000_000
#: bytes that the sums of a tree's open nodes may take at a time, and rows by features of a step
LEVEL_BYTES, STEP = 32_000_000, 1 << 20
#: features whose quantiles are found together
COLUMNS = 64
#: share of a node's squares below which a decrease is rounding
ROUNDING = 1e-14


def cuts_of(frame: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """Of each feature, the first so many, the values at which it may be cut; a row with that value goes left."""
    if not width:
        return []
    rows = frame.select(F.slice(vector_to_array(features), 1, width).alias("x"))

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[np.ndarray] = [np.zeros(0)] * width
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                # a feature with too many values is looked at no further
                known = [k if len(k) > BINS else np.unique(np.concatenate([k, np.unique(x[:, i])])) for i, k in enumerate(known)]
        yield pd.DataFrame({"feature": range(width), "found": [k[: BINS + 1] for k in known]})

    values = rows.mapInPandas(few, "feature int, found array<double>").select("feature", F.explode("found").alias("value"))
    listed = values.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("found")).collect()  # a row per feature
    cuts = [np.zeros(0)] * width
    many = []
    for row in listed:
        found = np.array(row["found"])
        if len(found) <= BINS:
            cuts[row["feature"]] = (found[:-1] + found[1:]) / 2
        else:
            many.append(row["feature"])
    shares = [i / BINS for i in range(1, BINS)]
    for start in range(0, len(many), COLUMNS):
        part = many[start : start + COLUMNS]
        wide = rows.select(*[F.get("x", F.lit(i)).alias(f"f{i}") for i in part])
        for i, found in zip(part, wide.approxQuantile(wide.columns, [*shares, 1.0], 1e-3)):
            cuts[i] = np.unique(found[:-1])
            cuts[i] = cuts[i][cuts[i] < found[-1]]  # nothing is right of the greatest value
    return cuts


def counted(frame: DataFrame, features: str, label: str, cuts: list[np.ndarray], groups: Sequence[int] = ()) -> DataFrame:
    """``codes, y, n``: rows with the same bins and target. A byte for each plain feature says how
    many cuts lie below its value, two for each group how many of its features are not before the
    one that is 1, so that bytes are in the order of the features."""
    p = len(cuts) - sum(groups)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = [np.searchsorted(c, batch[f"f{i}"]).astype("u1")[:, None] for i, c in enumerate(cuts[:p])]
                codes += [(size - batch[f"g{i}"].to_numpy()).astype(">u2")[:, None].view("u1") for i, size in enumerate(groups)]
                yield pd.DataFrame({"codes": [row.tobytes() for row in np.concatenate(codes, 1)], "y": batch["y"]})

    rows = frame.select(*tight_columns(features, len(cuts), groups), F.col(label).cast("double").alias("y"))
    return rows.mapInPandas(coded, "codes binary, y double").groupBy("codes", "y").agg(F.count(F.lit(1)).alias("n"))


def _collected(counts: DataFrame, bytes_of_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Codes, targets and counts, in order of codes and target; None where they are too many."""
    ensure_checkpoint_dir(counts.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                columns = {"y": batch["y"].to_numpy("f8").tobytes(), "n": batch["n"].to_numpy("i8").tobytes()}
                yield pd.DataFrame({"rows": [len(batch)], "codes": [b"".join(batch["codes"])], **{k: [v] for k, v in columns.items()}})

    blocks = counts.mapInPandas(pack, "rows bigint, codes binary, y binary, n binary").checkpoint()
    many = blocks.agg(F.sum("rows")).first()[0] or 0
    if not 0 < many <= min(SHARED_BYTES // (bytes_of_codes + 16), np.iinfo("i4").max):
        return None
    found = blocks.toPandas()  # of a checked number of bytes
    codes = np.frombuffer(b"".join(found.pop("codes")), "u1").reshape(many, -1)
    y, n = np.frombuffer(b"".join(found.pop("y"))), np.frombuffer(b"".join(found.pop("n")), "i8")
    order = np.lexsort([y, *codes.T[::-1]])  # draws go by place
    return codes[order], y[order], n[order]


def _gains(lw: np.ndarray, ls: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the cut that takes most variance away, and how much. ``lw`` and ``ls``: draws and
    targets left of cuts, per node; ``w`` and ``s``: those of the nodes."""
    rw, rs = w[:, None] - lw, s[:, None] - ls
    some = (lw > 0) & (rw > 0)
    a, b = ls / np.where(some, lw, 1.0), rs / np.where(some, rw, 1.0)
    gain = np.where(some, lw * rw / np.maximum(w, 1.0)[:, None] * (a - b) ** 2, 0.0)
    gain[gain <= ROUNDING * (lw * a * a + rw * b * b)] = 0.0
    best = gain.argmax(1)
    return best, gain[np.arange(len(best)), best]


def _best(sums: np.ndarray, w: np.ndarray, s: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the cut that takes most variance away, and how much. ``sums``: draws and
    targets between cuts, per node; ``w`` and ``s``: those of the nodes."""
    ends = np.cumsum(many)
    for start, end in zip(ends - many, ends):
        if end - start > 1:
            sums[:, :, start:end] = np.cumsum(sums[:, :, start:end], 2)
    return _gains(*sums, w, s)


def grow(codes: np.ndarray, w: np.ndarray, wy: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple[Tree, np.ndarray]:
    """A tree over binned rows, their weights and weighted targets; and the variance that each
    feature took away."""
    many = np.array([len(c) for c in cuts])
    offsets, slots = np.cumsum(many) - many, int(many.sum())
    of_slot, cut_of = np.repeat(np.arange(len(cuts)), many), np.concatenate(cuts)
    room, step = max(1, LEVEL_BYTES // (16 * (slots + 1))), max(1, STEP // len(cuts))
    gone = np.zeros(len(cuts))
    levels: list[tuple[np.ndarray, ...]] = []
    rows, place, nodes, born = np.arange(len(w)), np.zeros(len(w), "i8"), 1, 1
    for level in range(depth + 1):
        total_w, total_s = np.bincount(place, w[rows], nodes), np.bincount(place, wy[rows], nodes)
        best, gain = np.zeros(nodes, "i8"), np.zeros(nodes)
        if level < depth and slots:
            for first in range(0, nodes, room):  # rows are in order of node
                here = min(room, nodes - first)
                sums = np.zeros((2, here * (slots + 1)))
                begin, end = np.searchsorted(place, [first, first + here])
                for start in range(begin, end, step):
                    part = slice(start, min(end, start + step))
                    own = rows[part]
                    # what lies above a feature's last cut has a place that is left out
                    at = np.where(codes[own] < many, codes[own] + offsets, slots) + ((place[part] - first) * (slots + 1))[:, None]
                    for i, v in enumerate((w, wy)):
                        sums[i] += np.bincount(at.ravel(), np.repeat(v[own], len(cuts)), sums.shape[1])
                span = slice(first, first + here)
                best[span], gain[span] = _best(sums.reshape(2, here, -1)[:, :, :slots], total_w[span], total_s[span], many)
        split = gain > 0
        rank = np.cumsum(split) - 1
        value = total_s / np.where(total_w > 0, total_w, 1.0)
        if slots:
            feature, cut = np.where(split, of_slot[best], -1), np.where(split, cut_of[best], 0.0)
        else:
            feature, cut = np.full(nodes, -1), np.zeros(nodes)
        levels.append((feature.astype("i4"), cut, np.where(split, born + 2 * rank, -1).astype("i4"), value))
        if not split.any():
            break
        np.add.at(gone, feature[split], gain[split])
        going = split[place]
        rows, place = rows[going], place[going]
        right = codes[rows, feature[place]] > (best - offsets[feature])[place]
        place = 2 * rank[place] + right
        order = np.argsort(place, kind="stable")
        rows, place, nodes = rows[order], place[order], 2 * int(split.sum())
        born += nodes
    feature, cut, left, value = (np.concatenate(x) for x in zip(*levels))
    return Tree(feature, cut, left, value[:, None]), gone


def _lefts(data: TightRows, part: Level, w: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws and targets of each node, and of those what lies left of each cut."""
    m, p = len(part.sizes), len(data.plain)
    columns = [*(c.column for c in data.plain), *data.codes]
    bins = [*(many[:p] + 1), *(size + 1 for size in data.groups)]
    sums = [np.zeros((2, m, size)) for size in bins]
    total = np.zeros((2, m))
    for rows, place, nodes, _ in steps(part.rows, part.sizes):
        base, here, drawn = nodes[0], len(nodes), w.take(rows).astype("f8")
        at, weights = place - base, (drawn, drawn * data.y.take(rows))
        for i, v in enumerate(weights):
            total[i, base : base + here] += np.bincount(at, v, here)
        for own, column, size in zip(sums, columns, bins):
            slot = at * size + column.take(rows)
            for i, v in enumerate(weights):
                own[i, base : base + here] += np.bincount(slot, v, here * size).reshape(here, size)
    lefts = [np.cumsum(own, 2)[:, :, :-1] for own in sums[:p]]
    lefts += [total[:, :, None] - own[:, :, :-1] for own in sums[p:]]  # all but the ones
    return total, np.concatenate(lefts, 2)


def grow_tight(data: TightRows, w: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple[Tree, np.ndarray]:
    """As ``grow``, over rows kept tight and how often each is drawn."""
    many = np.array([len(c) for c in cuts])
    offsets, slots = np.cumsum(many) - many, int(many.sum())
    of_slot, cut_of = np.repeat(np.arange(len(cuts)), many), np.concatenate(cuts)
    room = max(1, LEVEL_BYTES // (64 * (slots + len(cuts))))
    gone, levels, born = np.zeros(len(cuts)), [], 1
    rows = np.flatnonzero(w).astype("i4")
    level = Level(rows, np.array([len(rows)]), np.zeros((1, 0)), np.zeros(1, "i8"))
    for left_over in range(depth, -1, -1):
        found = []
        for part in level.parts(room):
            total, lefts = _lefts(data, part, w, many)
            best, gain = _gains(*lefts, *total) if slots else (np.zeros(len(part.ids), "i8"), np.zeros(len(part.ids)))
            found.append((best, gain, total[1] / np.where(total[0] > 0, total[0], 1.0)))
        best, gain, value = (np.concatenate(x) for x in zip(*found))
        split = (gain > 0) & (left_over > 0)
        feature, cut, left = np.full(len(split), -1), np.zeros(len(split)), np.full(len(split), -1)
        feature[split], cut[split], left[split] = of_slot[best[split]], cut_of[best[split]], born + np.arange(0, 2 * split.sum(), 2)
        levels.append((feature, cut, left, value))
        if not split.any():
            break
        np.add.at(gone, feature[split], gain[split])
        level, feature, best = level.kept(split), feature[split], best[split]
        rows, lefts = parted(data, level, feature, (best - offsets[feature]).astype("f8"))
        sizes = np.stack([lefts, level.sizes - lefts], 1).ravel()
        level = Level(rows, sizes, np.zeros((len(sizes), 0)), born + np.arange(len(sizes)))
        born += len(sizes)
    feature, cut, left, value = (np.concatenate(x) for x in zip(*levels))
    return Tree(feature.astype("i4"), cut, left.astype("i4"), value[:, None]), gone


def _tight(codes: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], groups: Sequence[int]) -> TightRows:
    p = len(cuts) - sum(groups)
    plain = [Plain(np.ascontiguousarray(codes[:, i]), np.arange(len(cuts[i]) + 1.0)) for i in range(p)]
    of_groups = np.ascontiguousarray(codes[:, p:]).view(">u2")
    return TightRows(plain, [(size - of_groups[:, i]).astype("u1" if size < 256 else "u2") for i, size in enumerate(groups)], list(groups), y)


def _dense(data: TightRows) -> np.ndarray:
    """A byte per feature."""
    out = np.zeros((len(data.y), data.width), "u1")
    first = len(data.plain)
    for i, plain in enumerate(data.plain):
        out[:, i] = plain.column
    for code, size in zip(data.codes, data.groups):
        some = np.flatnonzero(code < size)
        out[some, first + code[some].astype("i8")] = 1
        first += size
    return out


def fit_binned_forest(
    frame: DataFrame, features: str, label: str, output: str, width: int, trees: int, depth: int, seed: int, groups: Sequence[int] = ()
) -> tuple[RandomTrees, list[float]] | None:
    """The forest and the importance of each feature (the mean of its shares in the trees); None
    where the counts are too many to share. The last features are ``groups`` of so many each, of
    which at most one is 1 in a row and the others are 0."""
    if width > WIDEST:
        return None
    spark, p = frame.sparkSession, width - sum(groups)
    cuts = [*cuts_of(frame, features, p), *[np.array([0.5])] * sum(groups)]
    found = _collected(counted(frame, features, label, cuts, groups), p + 2 * len(groups))
    if found is None:
        return None
    codes, y, n = found
    middle = float((y * n).sum() / n.sum())
    data = _tight(codes, y - middle, cuts, groups)
    dense = _dense(data) if len(n) * (width + 16) <= DENSE_BYTES else None
    if dense is not None:
        data = TightRows([], [], [], data.y)
    shared = spark.sparkContext.broadcast((dense, data, n.astype("u1" if n.max() < 256 else "i8")))

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense, data, n = shared.value
        for batch in batches:
            for number in batch["id"]:
                w = np.random.default_rng((seed, int(number))).poisson(n)
                if dense is None:
                    tree, gone = grow_tight(data, w.astype("i4"), cuts, depth)
                else:
                    drawn = np.flatnonzero(w)
                    tree, gone = grow(dense[drawn], w[drawn].astype("f8"), (w * data.y)[drawn], cuts, depth)
                parts = (tree.feature, tree.cut, tree.left, tree.value, gone / (gone.sum() or 1.0))
                yield pd.DataFrame({"tree": [number], **{name: [p.tobytes()] for name, p in zip(("feature", "cut", "left", "value", "gone"), parts)}})

    schema = "tree bigint, feature binary, cut binary, left binary, value binary, gone binary"
    rows = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(grown, schema).toPandas()
    shared.unpersist()
    rows = rows.sort_values("tree")
    forest = [
        Tree(np.frombuffer(f, "i4"), np.frombuffer(c), np.frombuffer(a, "i4"), middle + np.frombuffer(v).reshape(-1, 1))
        for f, c, a, v in zip(rows["feature"], rows["cut"], rows["left"], rows["value"])
    ]
    shares = sum(np.frombuffer(g) for g in rows["gone"])
    return RandomTrees(features, output, 0, forest), [float(g) for g in (shares / shares.sum() if shares.sum() > 0 else shares)]
