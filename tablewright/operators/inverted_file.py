"""Known rows in lists around learned centres, for nearest neighbours of many rows.

Centres are learned by k-means from a sample; each known row goes to its nearest centre, and
the rows of a centre are cut into lists by their distance from it (the residual), so that a
list is a shell around its centre. By the triangle inequality a list with residuals from
``low`` to ``high`` holds nothing nearer to a query than the larger of ``d - high`` and
``low - d``, where ``d`` is the query's distance from the centre.

A query first meets a few lists that promise near rows, one shell each of the nearest centres.
Their k-th best distance is its bound, and of all other lists only those that can hold
something within the bound are met: the answer is exact. With ``probes`` only the lists of
that many nearest centres are met, pruned by the same bound: the answer is approximate, and
the work per query no longer grows with the number of centres.

Known rows are packed by whole lists, queries into blocks, and both are written out once. Every
block meets every pack in a task that holds one of each: it computes distances only between
queries and lists that can hold something for them, and keeps each query's ``k`` best while it
goes. What is shuffled is the best of a few shares of the known rows for each query, not a copy
of the query for each list that it meets. Of known rows with equal vectors only the ``k`` with
the smallest ids can be an answer, so others of a crowd are left out; equal queries of a crowd
are asked once. Distances come from matrix products, and those that matter are computed
again from differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.session import ensure_checkpoint_dir

MAX_CENTRES = 4096
#: rows per centre that the centres are learned from
SAMPLED = 64
#: bytes of centres, and of facts about lists, that are sent to every task
SHARED_BYTES = 64_000_000
#: bytes of vectors in a pack of known rows, and in a block of queries
PACK_BYTES = 6_000_000
#: shares of the known rows that give a query's best each, and bytes of vectors in a share at most
SHARES, SHARE_BYTES = 4, 128_000_000
#: pairs of a query and a list in a block
WANTED = 32_000_000
#: distances, and differences of coordinates, that are held at once
DISTANCES, DIFFERENCES = 4_000_000, 16_000_000
#: distances of a query block that are held at once
MET, LOOKED_AT = 1_000_000, 4_000_000
#: lists that a query meets first
FIRST_LISTS = 3
#: lists among which these are sought before all are put in order
LIKELY_LISTS = 64

FOUND_SCHEMA = "query_id bigint, neighbour_id bigint, label double, distance double"
PACK_SCHEMA = (
    "list array<bigint>, cell array<int>, low array<double>, high array<double>, n array<bigint>, "
    "k_ids binary, k_missing binary, k_labels binary, k_vectors binary"
)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, by one matrix product."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def best(q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, squared distance) of the k nearest vectors of each query, best first;
    equal distances go to the smaller id."""
    out = []
    norm = (vectors * vectors).sum(1).max(initial=0.0)
    step = max(1, DISTANCES // max(1, len(vectors)))
    pairs = max(1, DIFFERENCES // max(1, vectors.shape[1]))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        d = squared(part, vectors)
        if len(ids) > k:
            # rounding of the product is far below this
            slack = 1e-13 * (vectors.shape[1] + 8) * ((part * part).sum(1) + norm)
            row, place = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        else:
            row, place = (x.ravel() for x in np.indices(d.shape))
        exact = np.concatenate(
            [((part[row[i : i + pairs]] - vectors[place[i : i + pairs]]) ** 2).sum(1) for i in range(0, len(row), pairs)] or [np.zeros(0)]
        )
        order = np.lexsort((ids[place], exact, row))
        row, place, exact = row[order], place[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((row[nth < k] + start, place[nth < k], exact[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def answer(query_ids, q, ids, labels, vectors, k: int) -> pd.DataFrame:
    if not len(q) or not len(ids):
        return pd.DataFrame({"query_id": [], "neighbour_id": [], "label": [], "distance": []})
    row, place, exact = best(q, ids, vectors, k)
    return pd.DataFrame(
        {"query_id": query_ids[row], "neighbour_id": ids[place], "label": labels[place], "distance": np.sqrt(exact)}
    )


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The k best per query of what several lists gave."""
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def _crowds(rows: DataFrame, more_than: int) -> DataFrame | None:
    """Hashes of vectors that more rows share than that; None where there are none."""
    counted = rows.groupBy(F.xxhash64("vector").alias("_spot")).agg(F.count(F.lit(1)).alias("n"))
    crowds = counted.filter(F.col("n") > more_than).select("_spot").checkpoint()
    return None if crowds.isEmpty() else crowds


def _thinned(known: DataFrame, k: int) -> DataFrame:
    """Without rows that k others with the same vector and smaller ids make needless."""
    crowds = _crowds(known, max(k, 100))
    if crowds is None:
        return known
    spot = known.withColumn("_spot", F.xxhash64("vector"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    rows = spot.join(crowds, "_spot")
    for keys in ([F.col("_spot"), F.col("vector"), part], [F.col("_spot"), F.col("vector")]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("_n") <= k).drop("_n")
    return spot.join(crowds, "_spot", "left_anti").unionByName(rows).drop("_spot")


def centres_of(known: DataFrame, rows: int, width: int, seed: int = 42) -> np.ndarray:
    """Centres learned from about ``SAMPLED`` rows for each."""
    count = max(2, min(math.isqrt(rows), MAX_CENTRES, SHARED_BYTES // (8 * max(width, 1))))
    drawn = known
    if rows > SAMPLED * count:
        drawn = known.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rows)) < SAMPLED * count)
    points = drawn.select(array_to_vector("vector").alias("v")).checkpoint()
    fitted = KMeans(k=count, featuresCol="v", maxIter=8, initMode="random", seed=seed).fit(points)
    return np.unique(np.stack(fitted.clusterCenters()), axis=0)


def _listed(size: int):
    """Rows in order of centre and residual, with the list they fall in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, cell, held = TaskContext.get().partitionId() << 32, -1, 0
        for batch in batches:
            cells = batch["cell"].to_numpy()
            if not len(cells):
                continue
            new = np.concatenate([[cells[0] != cell], cells[1:] != cells[:-1]])
            at = np.arange(len(cells))
            begin = np.maximum.accumulate(np.where(new, at, -held))
            lists = number + np.cumsum(new | ((at - begin) % size == 0))
            yield batch.assign(list=lists)
            number, cell, held = int(lists[-1]), int(cells[-1]), int(at[-1] - begin[-1]) + 1

    return run


def pack_rows(width: int) -> int:
    return max(1, PACK_BYTES // (8 * max(width, 1)))


def _ids(column: pd.Series) -> tuple[bytes, bytes]:
    """Ids, and which of them are missing."""
    return column.astype("Int64").fillna(0).to_numpy("i8").tobytes(), column.isna().to_numpy(bool).tobytes()


def _packed(size: int):
    """Rows in order of their lists as packs of whole lists, of up to ``size`` rows."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lists, residuals = rows["list"].to_numpy(), rows["residual"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        ids, missing = _ids(rows["id"])
        return pd.DataFrame({
            "list": [lists[first]], "cell": [rows["cell"].to_numpy()[first]],
            "low": [np.minimum.reduceat(residuals, first)], "high": [np.maximum.reduceat(residuals, first)],
            "n": [np.diff(first, append=len(lists))], "k_ids": [ids], "k_missing": [missing],
            "k_labels": [rows["label"].to_numpy(dtype=float).tobytes()], "k_vectors": [stacked(rows["vector"]).tobytes()],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) > size:
                lists = held["list"].to_numpy()
                ends = np.flatnonzero(lists[1:] != lists[:-1]) + 1
                if not len(ends):
                    break
                end = max(int(ends[0]), int(ends[ends <= size].max(initial=0)))
                yield pack(held.iloc[:end])
                held = held.iloc[end:]
        if held is not None and len(held):
            yield pack(held)

    return run


def _blocks(size: int):
    """Queries as blocks of up to ``size`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                ids, missing = _ids(part["id"])
                number += 1
                yield pd.DataFrame({"block": [number], "ids": [ids], "missing": [missing], "vectors": [stacked(part["vector"]).tobytes()]})

    return run


class _Block:
    """Queries of a block and the best of what they have met so far."""

    def __init__(self, row: dict, k: int, wanted):
        self.k, self.number = k, row["block"].as_py()
        self.ids, self.missing = np.frombuffer(row["ids"].as_buffer(), "i8"), np.frombuffer(row["missing"].as_buffer(), bool)
        self.x = np.frombuffer(row["vectors"].as_buffer()).reshape(len(self.ids), -1)
        self.size = (self.x * self.x).sum(1)
        n = len(self.ids)
        # squared distance beyond which nothing is an answer
        self.limit = np.full(n, np.inf)
        if "bounds" in row:
            self.limit = np.frombuffer(row["bounds"].as_buffer()) * (1 + 1e-9) + 1e-12
        self.squared, self.label = np.full((n, k), np.inf), np.zeros((n, k))
        self.near, self.unnamed = np.zeros((n, k), "i8"), np.zeros((n, k), bool)
        self.wanted = wanted(self.x, np.sqrt(self.limit))  # of each list, the queries that meet it

    def meet(self, row: dict, places: dict[int, int]) -> None:
        ids, missing = np.frombuffer(row["k_ids"].as_buffer(), "i8"), np.frombuffer(row["k_missing"].as_buffer(), bool)
        labels = np.frombuffer(row["k_labels"].as_buffer())
        y = np.frombuffer(row["k_vectors"].as_buffer()).reshape(len(ids), -1)
        end = 0
        for number, many in zip(row["list"].as_py(), row["n"].as_py()):
            start, end = end, end + many
            asked = np.flatnonzero(self.wanted[places[number]])
            step = max(1, MET // many)
            for begin in range(0, len(asked), step):
                self._compare(asked[begin : begin + step], y[start:end], ids[start:end], missing[start:end], labels[start:end])

    def _compare(self, asked, y, ids, missing, labels) -> None:
        x, size, limit = self.x[asked], self.size[asked], self.limit[asked]
        sizes = (y * y).sum(1)
        half = x @ y.T  # half of the squared distance without the query's own size
        np.subtract(0.5 * sizes, half, out=half)
        # rounding of the product is far below this
        slack = 1e-13 * (y.shape[1] + 8) * (size + sizes.max())
        reach = (limit - size) / 2 + slack
        unbound = np.flatnonzero(np.isinf(limit))
        if len(unbound) and len(ids) > self.k:
            reach[unbound] = np.partition(half[unbound], self.k - 1, axis=1)[:, self.k - 1] + slack[unbound]
        at, place = np.nonzero(half <= reach[:, None])
        if not len(at):
            return
        pairs = max(1, LOOKED_AT // max(1, y.shape[1]))
        exact = np.concatenate([((x[at[i : i + pairs]] - y[place[i : i + pairs]]) ** 2).sum(1) for i in range(0, len(at), pairs)])
        own, back = np.unique(at, return_inverse=True)
        rows, k = asked[own], self.k
        at = np.concatenate([back, np.repeat(np.arange(len(own)), k)])
        exact = np.concatenate([exact, self.squared[rows].ravel()])
        near, unnamed = np.concatenate([ids[place], self.near[rows].ravel()]), np.concatenate([missing[place], self.unnamed[rows].ravel()])
        label = np.concatenate([labels[place], self.label[rows].ravel()])
        order = np.lexsort((near, ~unnamed, exact, at))  # ids that are missing come first, as in Spark
        nth = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order = order[nth < k]  # k of each, as the places not yet taken count
        for held, found in ((self.squared, exact), (self.near, near), (self.unnamed, unnamed), (self.label, label)):
            held[rows] = found[order].reshape(-1, k)
        self.limit[rows] = np.minimum(self.limit[rows], self.squared[rows, -1] * (1 + 1e-9) + 1e-12)

    def found(self) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.squared))
        label = self.label[at, place]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[at], mask=self.missing[at]), pa.array(self.near[at, place], mask=self.unnamed[at, place]),
                pa.array(label, mask=np.isnan(label)), pa.array(np.sqrt(self.squared[at, place])),
            ],
            ["query_id", "neighbour_id", "label", "distance"],
        )

    def reached(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.number], "int64"), pa.array([self.squared.tobytes()], "binary")], ["block", "squared"])


def _bounds(k: int):
    """Per query of a block, the k-th best squared distance of all shares."""

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        best = None
        for data in parts["squared"]:
            own = np.frombuffer(data).reshape(-1, k)
            best = own if best is None else np.sort(np.concatenate([best, own], axis=1), axis=1)[:, :k]
        return pd.DataFrame({"block": parts["block"].iloc[:1].to_list(), "bounds": [best[:, -1].tobytes()]})

    return merged


class InvertedFile:
    """Lists of known rows (``id``, ``label``, ``vector``) around their centres, for answers of
    up to ``k`` neighbours."""

    def __init__(self, known: DataFrame, k: int, rows: int, width: int, list_rows: int):
        spark = known.sparkSession
        ensure_checkpoint_dir(spark)
        self.k = k
        known = _thinned(known.select("id", "label", "vector"), k)
        centres = spark.sparkContext.broadcast(centres_of(known, rows, width))

        @F.pandas_udf("struct<cell int, residual double>")
        def home(vectors: pd.Series) -> pd.DataFrame:
            x, cells, residuals = stacked(vectors), [], []
            step = max(1, DISTANCES // len(centres.value))
            for start in range(0, len(x), step):
                part = x[start : start + step]
                cell = squared(part, centres.value).argmin(1)
                cells.append(cell)
                residuals.append(np.sqrt(((part - centres.value[cell]) ** 2).sum(1)))
            return pd.DataFrame({"cell": np.concatenate(cells).astype("int32"), "residual": np.concatenate(residuals)})

        placed = known.withColumn("home", home("vector")).select("id", "label", "vector", "home.*")
        self.pack_rows = pack_rows(width)
        shares = max(SHARES, -(-8 * rows * width // SHARE_BYTES))
        ordered = placed.repartitionByRange(shares, "cell", "residual", "id").sortWithinPartitions("cell", "residual")
        schema = "id bigint, label double, vector array<double>, cell int, residual double, list bigint"
        self.rows = ordered.mapInPandas(_listed(min(list_rows, self.pack_rows)), schema)
        self.packs = self.rows.mapInPandas(_packed(self.pack_rows), PACK_SCHEMA).checkpoint()
        facts = self.packs.select(F.inline(F.arrays_zip("list", "cell", "low", "high", "n")))
        if facts.count() * 40 > SHARED_BYTES:
            raise ValueError("too many lists to share; raise the rows of a list")
        facts = facts.orderBy("cell", "low", "list").toPandas()
        self.shared = spark.sparkContext.broadcast((centres.value, {c: facts[c].to_numpy() for c in facts.columns}))

    def search(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """The nearest known rows of each query (``id``, ``vector``)."""
        queries = queries.select("id", "vector")
        crowds = _crowds(queries, 100)
        if crowds is None:
            return self._answers(queries, probes)
        spot = queries.withColumn("_spot", F.xxhash64("vector"))
        asked = spot.join(crowds, "_spot").groupBy("_spot", "vector").agg(F.min("id").alias("id"))
        asked = asked.checkpoint()
        single = spot.join(crowds, "_spot", "left_anti").select("id", "vector")
        found = self._answers(single.unionByName(asked.select("id", "vector")), probes).checkpoint()
        same = spot.join(asked.select("_spot", F.col("vector").alias("_vector"), F.col("id").alias("query_id")), "_spot")
        same = same.filter((F.col("vector") == F.col("_vector")) & (F.col("id") != F.col("query_id"))).select("query_id", "id")
        copied = found.join(same, "query_id").select(F.col("id").alias("query_id"), "neighbour_id", "label", "distance")
        return found.unionByName(copied)

    def _answers(self, queries: DataFrame, probes: int | None) -> DataFrame:
        size = max(1, min(self.pack_rows, WANTED // len(self.shared.value[1]["list"])))
        many = -(-queries.count() // size)
        # so many that each core gets a few tasks, of which there is one per share of the known rows
        parts = max(1, min(many, -(-3 * queries.sparkSession.sparkContext.defaultParallelism // SHARES)))
        blocks = queries.repartition(parts).mapInPandas(_blocks(size), "block bigint, ids binary, missing binary, vectors binary").checkpoint()
        first = self._met(blocks, self._starts(), "reached", "block bigint, squared binary")
        bounds = first.groupBy("block").applyInPandas(_bounds(self.k), "block bigint, bounds binary")
        bound = blocks.join(bounds, "block")
        return nearest_of(self._met(bound, self._opens(probes), "found", FOUND_SCHEMA), self.k)

    def _met(self, blocks: DataFrame, wanted, result: str, schema: str) -> DataFrame:
        """What blocks of queries find in each share of the known rows, in the lists they want."""
        shared, k = self.shared, self.k

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, block = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i] for name in batch.schema.names}
                    if places is None:
                        places = {int(number): place for place, number in enumerate(shared.value[1]["list"])}
                    if block is None or block.number != row["block"].as_py():
                        if block is not None:
                            yield getattr(block, result)()
                        block = _Block(row, k, wanted)
                    block.meet(row, places)
            if block is not None:
                yield getattr(block, result)()

        packs = self.packs.select("list", "n", "k_ids", "k_missing", "k_labels", "k_vectors").hint("shuffle_replicate_nl")
        return blocks.crossJoin(packs).mapInArrow(meet, schema)

    def _starts(self):
        """For the queries of a block, whether each list is one that they meet first."""
        shared, k = self.shared, self.k

        def wanted(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
            out, begin = np.zeros((len(shared.value[1]["list"]), len(x)), bool), 0
            for d, facts, gap in _gaps(x, *shared.value):
                for i, first in enumerate(_starting(d, facts, gap, k)):
                    out[first, begin + i] = True
                begin += len(d)
            return out

        return wanted

    def _opens(self, probes: int | None):
        """For the queries of a block, whether each list may hold something within the limit or,
        with ``probes``, is one of those that may and that are met."""
        shared, k = self.shared, self.k

        def wanted(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
            out, begin = np.zeros((len(shared.value[1]["list"]), len(x)), bool), 0
            for d, facts, gap in _gaps(x, *shared.value):
                met = gap <= limits[begin : begin + len(d), None]
                if probes is not None:
                    met &= _probed(d, facts, probes)
                    for row, first in zip(met, _starting(d, facts, gap, k)):
                        row[first] = True
                out[:, begin : begin + len(d)] = met.T
                begin += len(d)
            return out

        return wanted

    def _first(self):
        """Lists that a query meets first."""
        shared, k = self.shared, self.k

        @F.pandas_udf("array<bigint>")
        def chosen(vectors: pd.Series) -> pd.Series:
            out = []
            for d, facts, gap in _gaps(stacked(vectors), *shared.value):
                out += [facts["list"][row] for row in _starting(d, facts, gap, k)]
            return pd.Series(out)

        return chosen

    def _rest(self, probes: int | None):
        """Lists that may hold something within the bound and were not met first."""
        shared, k = self.shared, self.k

        @F.pandas_udf("array<bigint>")
        def chosen(vectors: pd.Series, bounds: pd.Series) -> pd.Series:
            out, limits = [], bounds.to_numpy() * (1 + 1e-9) + 1e-12
            begin = 0
            for d, facts, gap in _gaps(stacked(vectors), *shared.value):
                met = gap <= limits[begin : begin + len(d), None]
                if probes is not None:
                    met &= _probed(d, facts, probes)
                for row, first in zip(met, _starting(d, facts, gap, k)):
                    row[first] = False
                    out.append(facts["list"][row])
                begin += len(d)
            return pd.Series(out)

        return chosen


def _probed(d: np.ndarray, facts: dict, probes: int) -> np.ndarray:
    """Whether a list is one of the nearest centres'."""
    cells = facts["centre"]
    last = min(probes, cells.shape[1]) - 1
    return d <= np.partition(cells, last, axis=1)[:, last][:, None]


def _gaps(x: np.ndarray, centres: np.ndarray, facts: dict) -> Iterator[tuple[np.ndarray, dict, np.ndarray]]:
    """For some queries at a time: distance from each list's centre, the lists, and the least
    distance that a row of the list can have."""
    cells = np.unique(facts["cell"])
    largest = np.sqrt((centres * centres).sum(1)).max()
    step = max(1, MET // max(len(centres), len(facts["list"])))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        near = np.sqrt(squared(part, centres))
        d = near[:, facts["cell"]]
        # the product's rounding must not rule out a list
        slack = 1e-7 * (np.sqrt((part * part).sum(1)) + largest)
        gap = np.maximum(np.maximum(d - facts["high"], facts["low"] - d), 0.0) - slack[:, None]
        yield d, {**facts, "centre": near[:, cells]}, gap


def _starting(d: np.ndarray, facts: dict, gap: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Places of the lists that each query meets first: by distance from the centre with what a
    list is off, until they hold k rows, and ``FIRST_LISTS`` at least."""
    middle = (facts["low"] + facts["high"]) / 2
    promise = np.hypot(d, d - middle) + gap
    if promise.shape[1] > LIKELY_LISTS:
        likely = np.sort(np.argpartition(promise, LIKELY_LISTS - 1, axis=1)[:, :LIKELY_LISTS], axis=1)
        order = np.take_along_axis(likely, np.argsort(np.take_along_axis(promise, likely, 1), axis=1, kind="stable"), 1)
        if (facts["n"][order].sum(1) < k).any():
            order = np.argsort(promise, axis=1, kind="stable")
    else:
        order = np.argsort(promise, axis=1, kind="stable")
    held = np.cumsum(facts["n"][order], axis=1)
    enough = np.maximum((held < k).sum(1) + 1, FIRST_LISTS)
    for row, many in zip(order, enough):
        yield row[:many]
