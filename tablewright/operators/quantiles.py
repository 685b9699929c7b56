"""Exact quantiles that do not gather a column in one task.

Spark's ``percentile`` keeps every distinct value of a column in one hash map, which is
right for small tables only. Here a quantile is bracketed by a sketch, the rows below
and inside the bracket are counted, and the few values left inside are ranked. The
counts make the result exact whatever the sketch's error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import col

SKETCH_ACCURACY = 10_000
#: most distinct values ranked in one window group
RANKED_VALUES = 500_000


@dataclass
class _Target:
    name: str
    probability: float
    position: float
    low: float
    high: float
    below: int = 0
    at_low: int = 0
    inner: int = 0
    at_high: int = 0

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    def spot(self, rank: int) -> str:
        offset = rank - self.below
        for label, width in (("low", self.at_low), ("inner", self.inner), ("high", self.at_high)):
            if 0 <= offset < width:
                return label
            offset -= width
        return "outside"


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int | None = None,
    ranked_values: int = RANKED_VALUES,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; see :func:`quantiles_and_more`."""
    return quantiles_and_more(df, columns, probabilities, (), accuracy, ranked_values)[0]


def quantiles_and_more(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    also: Sequence[Column],
    accuracy: int | None = None,
    ranked_values: int = RANKED_VALUES,
    rows: int | None = None,
) -> tuple[dict[str, list[float | None]], Row]:
    """Linearly interpolated quantiles per column, missing values left out, and a row of
    other aggregates over ``x0``, ``x1``, ... (the columns as doubles) from the first pass.

    Runs a sketch pass, a count pass and a ranking pass over the named columns alone;
    each further factor of about ``accuracy / 8`` in rows costs two passes more.
    """
    values = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    if accuracy is None:
        # just fine enough for the first bracket to be small enough to rank
        accuracy = SKETCH_ACCURACY if rows is None else min(SKETCH_ACCURACY, max(500, 16 * rows // ranked_values))
    slack = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-slack, slack)})
    aggregates = []
    for i in range(len(columns)):
        x = F.col(f"x{i}")
        aggregates += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.percentile_approx(x, points, accuracy).alias(f"s{i}"),
        ]
    seen = values.agg(*aggregates, *also).first()
    extent = {i: (seen[f"lo{i}"], seen[f"hi{i}"]) for i in range(len(columns))}
    targets: list[_Target] = []
    for i in range(len(columns)):
        n = seen[f"n{i}"]
        if not n:
            continue
        sketch = dict(zip(points, seen[f"s{i}"]))
        for p in probabilities:
            low = sketch[min(1.0, max(0.0, p - slack))]
            high = sketch[min(1.0, max(0.0, p + slack))]
            targets.append(_Target(f"x{i}", p, (n - 1) * p, low, high))

    pending = list(targets)
    while pending:
        _count(values, pending)
        narrow = []
        for t in pending:
            spots = {t.spot(r) for r in t.ranks}
            if "outside" in spots:
                first, last = extent[int(t.name[1:])]
                if t.ranks[0] < t.below:
                    t.low, t.high = first, t.low
                if t.ranks[1] >= t.below + t.at_low + t.inner + t.at_high:
                    t.low, t.high = t.high, last
                narrow.append(t)
            elif "inner" in spots and t.inner > ranked_values:
                narrow.append(t)
        _narrow(values, [t for t in narrow if t.inner > ranked_values and "outside" not in {t.spot(r) for r in t.ranks}], accuracy)
        pending = narrow

    ranked = _rank(values, [t for t in targets if "inner" in {t.spot(r) for r in t.ranks}])
    found: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for t in targets:
        picked = []
        for rank in t.ranks:
            spot = t.spot(rank)
            if spot == "low":
                picked.append(t.low)
            elif spot == "high":
                picked.append(t.high)
            else:
                picked.append(ranked[(t.name, t.probability, rank)])
        lower, upper = picked
        share = t.position - math.floor(t.position)
        place = list(probabilities).index(t.probability)
        found[columns[int(t.name[1:])]][place] = _between(lower, upper, share)
    return found, seen


def _between(lower: float, upper: float, share: float) -> float:
    """Linear interpolation; a side without weight does not count, even if infinite."""
    if upper == lower or share == 0:
        return lower
    return lower * (1 - share) + upper * share if abs(lower) == math.inf or abs(upper) == math.inf else lower + (upper - lower) * share


def _count(values: DataFrame, targets: list[_Target]) -> None:
    aggregates = []
    for j, t in enumerate(targets):
        x, low, high = F.col(t.name), F.lit(t.low), F.lit(t.high)
        aggregates += [
            F.count_if(x < low).alias(f"b{j}"),
            F.count_if(x == low).alias(f"l{j}"),
            F.count_if((x > low) & (x < high)).alias(f"i{j}"),
            F.count_if((x == high) & (high > low)).alias(f"h{j}"),
        ]
    row = values.agg(*aggregates).first()
    for j, t in enumerate(targets):
        t.below, t.at_low, t.inner, t.at_high = row[f"b{j}"], row[f"l{j}"], row[f"i{j}"], row[f"h{j}"]


def _narrow(values: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """Bracket each target again by a sketch over the values inside its bracket."""
    if not targets:
        return
    aggregates = []
    for j, t in enumerate(targets):
        x = F.col(t.name)
        within = F.when((x > F.lit(t.low)) & (x < F.lit(t.high)), x)
        first, last = t.ranks
        start = max(0.0, (first - t.below - t.at_low) / t.inner - 2.0 / accuracy)
        stop = min(1.0, (last - t.below - t.at_low) / t.inner + 2.0 / accuracy)
        aggregates.append(F.percentile_approx(within, [min(start, 1.0), max(stop, 0.0)], accuracy).alias(f"s{j}"))
    row = values.agg(*aggregates).first()
    for j, t in enumerate(targets):
        low, high = row[f"s{j}"]
        first, last = t.ranks
        # a rank on the old edge keeps that edge
        if t.spot(first) == "inner":
            t.low = low
        if t.spot(last) == "inner":
            t.high = high


def _rank(values: DataFrame, targets: list[_Target]) -> dict[tuple[str, float, int], float]:
    """Values at the wanted ranks inside each bracket, whose size was checked before."""
    if not targets:
        return {}
    inside, structs, wanted = None, [], None
    for j, t in enumerate(targets):
        x = F.col(t.name)
        hit = (x > F.lit(t.low)) & (x < F.lit(t.high))
        inside = hit if inside is None else inside | hit
        structs.append(F.struct(F.lit(j).alias("target"), F.when(hit, x).alias("value")))
        for rank in {r for r in t.ranks if t.spot(r) == "inner"}:
            offset = rank - t.below - t.at_low
            reached = (
                (F.col("target") == j)
                & (F.col("upto") > offset)
                & (F.col("upto") - F.col("n") <= offset)
            )
            wanted = reached if wanted is None else wanted | reached
    counted = (
        values.filter(inside)
        .select(F.inline(F.array(*structs)))
        .filter(F.col("value").isNotNull())
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    picked = counted.withColumn("upto", F.sum("n").over(running)).filter(wanted).collect()
    out = {}
    for row in picked:
        t = targets[row["target"]]
        start = t.below + t.at_low + row["upto"] - row["n"]
        for rank in t.ranks:
            if start <= rank < start + row["n"]:
                out[(t.name, t.probability, rank)] = row["value"]
    return out
