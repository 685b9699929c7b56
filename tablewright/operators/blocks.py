"""Rows of numbers packed into blocks, for learners that go over them many times.

A block holds some thousand rows as one matrix, so a pass over the data costs a numpy call
per block and no conversion. What tasks find is added up in two steps: a partial result per
task, those of every ``GATHERED`` tasks' remainder class together, and the few of these on
the driver; so no step holds more than its share of partial results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import ensure_checkpoint_dir

BLOCK = 8192
#: partial results that reach the driver of one pass
GATHERED = 16
#: widest rows that are packed, as they are dense
WIDEST = 4096


def check_width(width: int, what: str) -> None:
    if width > WIDEST:
        raise ValueError(f"{what} reads dense rows of up to {WIDEST} features, and there are {width}; leave out wide categories")


def packed(frame: DataFrame, features: str, label: str) -> DataFrame:
    """``n, x, y``: blocks of rows as bytes of doubles, written out once."""
    ensure_checkpoint_dir(frame.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                x = np.stack(part["x"].to_numpy()).astype("f8")
                yield pd.DataFrame({"n": [len(part)], "x": [x.tobytes()], "y": [part["y"].to_numpy(dtype="f8").tobytes()]})

    rows = frame.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInPandas(pack, "n int, x binary, y binary").checkpoint()


def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, x, y in zip(batch["n"], batch["x"], batch["y"]):
            yield np.frombuffer(x).reshape(n, -1), np.frombuffer(y)


Arrays = list[np.ndarray]


def gather(blocks: DataFrame, found: Callable[[np.ndarray, np.ndarray], Arrays], merge: Callable[[Arrays, Arrays], Arrays]) -> Arrays | None:
    """What ``found`` gives for each block (a fixed number of arrays of doubles, of fixed
    shapes), merged over all blocks; None without rows."""

    def flat(arrays: Arrays) -> bytes:
        return np.concatenate([a.ravel() for a in arrays]).astype("f8").tobytes()

    def shapes_of(arrays: Arrays) -> list[int]:
        return [len(arrays), *(x for a in arrays for x in (a.ndim, *a.shape))]

    def restored(shape: list[int], data: bytes) -> Arrays:
        numbers, out, at, place = np.frombuffer(data), [], 0, 1
        for _ in range(shape[0]):
            dims = [int(x) for x in shape[place + 1 : place + 1 + int(shape[place])]]
            place += 1 + len(dims)
            size = int(np.prod(dims))
            out.append(numbers[at : at + size].reshape(dims))
            at += size
        return out

    def over_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Arrays | None = None
        for x, y in matrices(batches):
            own = found(x, y)
            total = own if total is None else merge(total, own)
        if total is not None:
            part = TaskContext.get().partitionId() % GATHERED
            yield pd.DataFrame({"part": [part], "shape": [shapes_of(total)], "data": [flat(total)]})

    def over_tasks(group: pd.DataFrame) -> pd.DataFrame:
        total = _merged(group)
        return pd.DataFrame({"part": group["part"].iloc[:1].to_list(), "shape": [shapes_of(total)], "data": [flat(total)]})

    def _merged(rows: pd.DataFrame) -> Arrays:
        total: Arrays | None = None
        for shape, data in zip(rows["shape"], rows["data"]):
            own = restored([int(x) for x in shape], data)
            total = own if total is None else merge(total, own)
        return total

    schema = "part int, shape array<bigint>, data binary"
    partial = blocks.mapInPandas(over_blocks, schema)
    if blocks.rdd.getNumPartitions() > GATHERED:
        partial = partial.groupBy("part").applyInPandas(over_tasks, schema)
    rows = partial.toPandas()  # GATHERED rows at most
    return _merged(rows) if len(rows) else None


def added(a: Arrays, b: Arrays) -> Arrays:
    return [x + y for x, y in zip(a, b)]
