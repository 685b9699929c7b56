"""Train/test split with exact sizes, without gathering a class in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import col
from tablewright.functions.numbering import numbered
from tablewright.session import ensure_checkpoint_dir

SEED = 42
ROW_ID = "_row_id"
IS_TEST = "_is_test"

#: most rows of one class ranked in a window; more are narrowed down by counting first
RANKED_ROWS = 200_000
#: classes up to this many have their cuts in an expression; those of more are joined
LISTED_CLASSES = 1_000


def with_row_id(df: DataFrame) -> DataFrame:
    """Rows with an id that later passes see unchanged, as it is written out once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn(ROW_ID, F.monotonically_increasing_id()).checkpoint()


def test_quotas(counts: Sequence[int], test_size: float, stratified: bool = True) -> list[int]:
    """Test rows per class: ``ceil(n * test_size)`` in all, shared out in proportion with
    the largest remainders rounded up on the training side."""
    total = sum(counts)
    test_rows = math.ceil(total * test_size)
    train_rows = total - test_rows
    if train_rows < 1 or test_rows < 1:
        raise ValueError(f"test_size {test_size} leaves no rows on one side of the split")
    if not stratified:
        return [test_rows]
    if min(train_rows, test_rows) < len(counts):
        raise ValueError(f"{len(counts)} classes need as many rows in the training and in the test part")
    ideal = [c * train_rows / total for c in counts]
    train = [math.floor(x) for x in ideal]
    order = sorted(range(len(counts)), key=lambda i: (train[i] - ideal[i], i))
    for i in order[: train_rows - sum(train)]:
        train[i] += 1
    return [c - t for c, t in zip(counts, train)]


def row_hash(key: Sequence[str], seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), *[col(k) for k in key])


def hash_name(key: Sequence[str], seed: int = SEED) -> str:
    """Column of a row's hash, where it was computed before the rows were joined to others."""
    return f"_row_hash_{seed}_{'_'.join(key)}"


def _hash_of(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    name = hash_name(key, seed)
    return col(name) if name in df.columns else row_hash(key, seed)


def assign_split(
    df: DataFrame,
    test_size: float,
    key: Sequence[str],
    label: str | None = None,
    classes: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """Adds the boolean ``_is_test``: the rows with the smallest key hashes of each class.

    ``label`` holds class numbers 0 to ``classes`` - 1; without it there is one class.
    The cut hash of every class is found by counting rows per hash prefix, so the
    assignment itself is a comparison per row and the same on any partitioning. Rows
    sharing a key share a side; with unique keys the sizes are exact.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if label and classes > LISTED_CLASSES:
        return _assign_by_tables(df, test_size, key, label, seed)
    group = F.coalesce(col(label).cast("int"), F.lit(0)) if label else F.lit(0)
    hashed = df.select(group.alias("class"), row_hash(key, seed).alias("h"))
    sizes = {r["class"]: r["n"] for r in hashed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get(c, 0) for c in range(classes)]
    stratified = label is not None and min(counts) >= 2
    if not stratified:
        hashed, counts, group = hashed.withColumn("class", F.lit(0)), [sum(counts)], F.lit(0)
    quotas = test_quotas(counts, test_size, stratified)
    cuts = _cut_hashes(hashed, quotas)
    cut = F.lit(cuts[0]) if len(cuts) == 1 else F.get(F.array(*map(F.lit, cuts)), group)
    return df.withColumn(IS_TEST, row_hash(key, seed) <= cut)


def _assign_by_tables(df: DataFrame, test_size: float, key: Sequence[str], label: str, seed: int) -> DataFrame:
    """As :func:`assign_split` for any number of classes: quotas and cuts are tables with a row
    per class, and the driver sees sums. Classes and hashes are written out once, as each pass
    would else look up all rows' classes anew."""
    ensure_checkpoint_dir(df.sparkSession)
    hashed = df.select(F.coalesce(col(label).cast("bigint"), F.lit(0)).alias("class"), _hash_of(df, key, seed).alias("h")).checkpoint()
    counts = hashed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    quotas = _quota_table(counts, test_size)
    if quotas is None:
        return assign_split(df, test_size, key, None, 1, seed)
    most = counts.agg(F.max("n")).first()[0]
    cuts = _ranked_cuts(hashed, quotas.withColumnRenamed("quota", "left")) if most <= RANKED_ROWS else _cut_table(hashed, quotas)
    names = cuts.select(F.col("class").alias("_cut_class"), "cut")
    group = F.coalesce(col(label).cast("bigint"), F.lit(0))
    cut = F.coalesce("cut", F.lit(-(2**63)))  # below every hash: a class without test rows
    # hashed before the join, which then need not move the key
    marked = df.withColumn("_row_hash", _hash_of(df, key, seed)).join(names, group == F.col("_cut_class"), "left")
    return marked.withColumn(IS_TEST, F.col("_row_hash") <= cut).drop("_row_hash", "_cut_class", "cut")


def _quota_table(counts: DataFrame, test_size: float) -> DataFrame | None:
    """``class, quota`` of test rows from ``class, n``, by the rule of :func:`test_quotas`; None
    where a class has a single row, so that classes cannot be kept in proportion."""
    total, classes, least = counts.agg(F.sum("n"), F.count(F.lit(1)), F.min("n")).first()
    if least < 2:
        return None
    test_rows = math.ceil(total * test_size)
    train_rows = total - test_rows
    if min(train_rows, test_rows) < classes:
        raise ValueError(f"{classes} classes need as many rows in the training and in the test part")
    ideal = F.col("n") * F.lit(train_rows).cast("double") / F.lit(total).cast("double")
    shared = counts.select("class", "n", F.floor(ideal).alias("base"), (F.floor(ideal) - ideal).alias("short"))
    placed = numbered(shared, ["short", "class"]).checkpoint()
    spare = train_rows - placed.agg(F.sum("base")).first()[0]
    up = F.when(F.col("place") < spare, 1).otherwise(0)
    return placed.select("class", (F.col("n") - F.col("base") - up).alias("quota"))


def _cut_table(hashed: DataFrame, quotas: DataFrame, bits: int = 8) -> DataFrame:
    """``class, cut``: the hash of the row at each class's quota in hash order."""
    left = quotas.filter("quota > 0").select("class", F.col("quota").alias("left")).checkpoint()
    shift, narrowed = 64 - bits, hashed.join(left.select("class"), "class")
    while True:
        counted = narrowed.groupBy("class", F.shiftright("h", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("class").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            counted.withColumn("upto", F.sum("n").over(upto)).join(left, "class")
            .filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
            .select("class", "prefix", "n", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))
            .checkpoint()
        )
        most = found.agg(F.max("n")).first()[0]
        if shift == 0 or most is None:
            return found.select("class", F.col("prefix").alias("cut"))
        left = found.select("class", "left")
        places = found.select("class", "prefix")
        narrowed = hashed.join(places, "class").filter(F.shiftright("h", shift) == F.col("prefix")).drop("prefix")
        if most <= RANKED_ROWS:
            break
        shift = max(0, shift - bits)
    return _ranked_cuts(narrowed, left)


def _ranked_cuts(hashed: DataFrame, left: DataFrame) -> DataFrame:
    """``class, cut`` of classes whose rows can be ranked: the hash at place ``left``."""
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("h")))
    return ranked.join(left, "class").filter(F.col("rank") == F.col("left")).select("class", F.col("h").alias("cut"))


def _cut_hashes(hashed: DataFrame, quotas: list[int]) -> list[int]:
    """Per class, the hash of the row at its quota in hash order."""
    bits = max(4, 16 - math.ceil(math.log2(len(quotas))) if len(quotas) > 1 else 16)
    shift = 64 - bits
    left = dict(enumerate(quotas))
    left = {c: q for c, q in left.items() if q > 0}
    prefix: dict[int, int] | None = None
    narrowed = hashed.filter(F.col("class").isin(list(left)))
    while left:
        counted = narrowed.groupBy("class", F.shiftright("h", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("class").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        wanted = _by_class(left, len(quotas))
        found = (
            counted.withColumn("upto", F.sum("n").over(upto))
            .filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
            .collect()
        )
        prefix = {r["class"]: r["prefix"] for r in found}
        left = {r["class"]: left[r["class"]] - (r["upto"] - r["n"]) for r in found}
        narrowed = hashed.filter(F.shiftright("h", shift) == _by_class(prefix, len(quotas)))
        if shift == 0 or max(r["n"] for r in found) <= RANKED_ROWS:
            break
        shift = max(0, shift - bits)
    cuts = [-(2**63)] * len(quotas)  # below every hash: a class without test rows
    if shift == 0 and prefix is not None:
        for c, h in prefix.items():
            cuts[c] = h
        return cuts
    ranked = narrowed.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("h")))
    for r in ranked.filter(F.col("rank") == _by_class(left, len(quotas))).collect():
        cuts[r["class"]] = r["h"]
    return cuts


def _by_class(values: dict[int, int], classes: int) -> Column:
    listed = [F.lit(values.get(c)).cast("bigint") for c in range(classes)]
    return listed[0] if classes == 1 else F.get(F.array(*listed), F.col("class"))


def sample_rows(df: DataFrame, rows: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """The given number of rows, picked by key hash; each task keeps at most that many."""
    order = [F.asc("_hash"), *[F.asc(col(k)) for k in key]]
    return df.withColumn("_hash", row_hash(key, seed)).orderBy(*order).limit(rows).drop("_hash")
