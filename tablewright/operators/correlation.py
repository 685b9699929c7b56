"""Pearson correlation over pairs of columns, pairwise complete.

Two passes: a mean per column, then one fold over all pairs together. Of each batch, with
``X`` the centred values (0 where missing) and ``M`` whether they are there, the products
``M'M``, ``X'M``, ``(X^2)'M`` and ``X'X`` hold every pair's count and sums, whatever is
missing. Tasks add up their own; what they send grows with the pairs, not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    as_double,
    col,
    finite,
    numeric_columns,
    rows_to_frame,
    tidy,
)

#: a column whose variance within a pair is this small beside its square is constant there
CONSTANT = 1e-13


@dataclass
class PairResult:
    pairs: int
    correlation: float | None


def pair_correlations(values: DataFrame, pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], PairResult]:
    """Correlation and number of complete rows for pairs of double columns.

    Infinite values make a pair's correlation undefined. Undefined is None, as is a
    constant column. The result grows with the number of pairs, not with the rows.
    """
    pairs = list(pairs)
    names = sorted({n for p in pairs for n in p})
    if not names:
        return {}
    index = {n: i for i, n in enumerate(names)}
    inf = float("inf")
    facts = []
    for i, n in enumerate(names):
        bounded = F.when(F.abs(col(n)) < inf, col(n))
        facts += [F.avg(bounded).alias(f"m{i}"), F.min(bounded).alias(f"lo{i}"), F.max(bounded).alias(f"hi{i}")]
    seen = values.agg(*facts).first()
    means = np.array([seen[f"m{i}"] or 0.0 for i in range(len(names))])
    # whole columns of one value are known exactly
    constant = [seen[f"lo{i}"] is None or seen[f"lo{i}"] == seen[f"hi{i}"] for i in range(len(names))]
    wanted = np.unique([sorted((index[a], index[b])) for a, b in pairs], axis=0)
    folded = values.select(*[col(n).alias(f"v{i}") for i, n in enumerate(names)]).mapInPandas(
        _fold(means, wanted), "part int, i int, j int, " + ", ".join(f"{c} double" for c in SUMS)
    )
    # first what a share of the tasks found of a pair, then those: no task meets all tasks' rows
    for key in (["part", "i", "j"], ["i", "j"]):
        folded = folded.groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = {(r["i"], r["j"]): r for r in folded.collect()}
    out = {}
    for a, b in pairs:
        i, j = index[a], index[b]
        row = sums.get((min(i, j), max(i, j)))
        out[(a, b)] = PairResult(0, None) if row is None else PairResult(int(row["n"]), None if constant[i] or constant[j] else _resolve(row))
    return out


#: shares of the tasks whose sums are added up first
PARTS = 32
SUMS = ["n", "unbounded", "x", "y", "xx", "yy", "xy"]


def _fold(means: np.ndarray, wanted: np.ndarray):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(means)
        total = {c: np.zeros((width, width)) for c in ("n", "unbounded", "x", "xx", "xy")}
        some = False
        for batch in batches:
            some |= len(batch) > 0
            raw = batch.to_numpy(dtype="f8", na_value=np.nan)
            there = ~np.isnan(raw)
            endless = np.isinf(raw)
            x = np.where(there & ~endless, raw - means, 0.0)
            m = there.astype("f8")
            total["n"] += m.T @ m
            if endless.any():
                e = endless.astype("f8")
                total["unbounded"] += e.T @ m + m.T @ e
            total["x"] += x.T @ m
            total["xx"] += (x * x).T @ m
            total["xy"] += x.T @ x
        if some:
            i, j = wanted[:, 0], wanted[:, 1]
            yield pd.DataFrame(
                {
                    "part": TaskContext.get().partitionId() % PARTS, "i": i, "j": j, "n": total["n"][i, j], "unbounded": total["unbounded"][i, j],
                    "x": total["x"][i, j], "y": total["x"][j, i], "xx": total["xx"][i, j], "yy": total["xx"][j, i],
                    "xy": total["xy"][i, j],
                }
            )

    return fold


def _resolve(row) -> float | None:
    n = row["n"]
    if n == 0 or row["unbounded"]:
        return None
    xx, yy = row["xx"] - row["x"] ** 2 / n, row["yy"] - row["y"] ** 2 / n
    if xx <= CONSTANT * row["xx"] or yy <= CONSTANT * row["yy"]:
        return None
    return _ratio(row["xy"] - row["x"] * row["y"] / n, xx, yy)


def _ratio(product: float, square_a: float, square_b: float) -> float | None:
    bottom = (square_a**0.5) * (square_b**0.5) if square_a > 0 and square_b > 0 else 0.0
    if bottom == 0.0 or bottom != bottom or product != product:
        return None
    return max(-1.0, min(1.0, product / bottom))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``x, y, value`` for every ordered pair of numeric columns; undefined is 0.

    Fewer than two columns give no rows. Infinite values count as missing.
    """
    df = tidy(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    schema = "x string, y string, value double"
    if len(names) < 2:
        return rows_to_frame(df.sparkSession, [], schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = df.select(*[finite(as_double(c, types[c])).alias(c) for c in names])
    upper = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    found = pair_correlations(values, upper)
    rows = []
    for a, b in upper:
        result = found[(a, b)]
        value = result.correlation or 0.0
        if a == b:
            value = 0.0 if result.correlation is None else 1.0
        rows.append((a, b, value))
        if a != b:
            rows.append((b, a, value))
    return rows_to_frame(df.sparkSession, rows, schema)
