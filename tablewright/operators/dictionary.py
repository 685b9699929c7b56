"""Categories and classes too many to list: numbered in tables, joined to the rows.

A dictionary is a table with a row per category and its place in sorted order. It is counted
and numbered by Spark, joined to the rows (by broadcast only below a checked number of
bytes), and saved and loaded beside the model; the driver knows its size and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.numbering import numbered

#: bytes of a dictionary that are sent to every task
BROADCAST_BYTES = 16_000_000
#: bytes that a row of a dictionary takes beside its text
ROW_BYTES = 24


@dataclass
class Size:
    rows: int
    bytes: int

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES


def size_of(dictionary: DataFrame, text: str) -> Size:
    rows, letters = dictionary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return Size(rows, letters + ROW_BYTES * rows)


def class_dictionary(texts: DataFrame) -> DataFrame:
    """``class, label`` of the distinct values of the one column of ``texts``; labels are places in
    sorted order."""
    distinct = texts.toDF("class").distinct()
    return numbered(distinct, ["class"], "label").withColumn("label", F.col("label").cast("double")).checkpoint()


def looked_up(df: DataFrame, dictionary: DataFrame, small: bool, left: str, right: str) -> DataFrame:
    """``df`` with the dictionary's other columns beside ``left``, null where it lacks the value."""
    rows = dictionary.withColumnRenamed(right, "_looked_up")
    rows = F.broadcast(rows) if small else rows
    return df.join(rows, F.col(left) == F.col("_looked_up"), "left").drop("_looked_up")


class FeatureVector(Transformer, MLReadable, MLWritable):
    """One sparse vector from columns of numbers and, by a dictionary, columns of texts.

    The dictionary has ``column`` (number of the text column), ``category`` and ``place``. A text
    that it lacks leaves its part of the vector empty.
    """

    numbers = Param(Params._dummy(), "numbers", "columns of numbers", TypeConverters.toListString)
    texts = Param(Params._dummy(), "texts", "columns of texts", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "categories of each column of texts", TypeConverters.toListInt)
    sent = Param(Params._dummy(), "sent", "whether each column's dictionary is small", TypeConverters.toListInt)
    output = Param(Params._dummy(), "output", "column of the vector", TypeConverters.toString)

    def __init__(self, numbers=(), texts=(), sizes=(), sent=(), output="features", dictionary: DataFrame | None = None):
        super().__init__()
        self._set(numbers=list(numbers), texts=list(texts), sizes=list(sizes), sent=list(sent), output=output)
        self.dictionary = dictionary

    def copy(self, extra=None):
        other = super().copy(extra)
        other.dictionary = self.dictionary
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers, texts, sizes = (self.getOrDefault(p) for p in (self.numbers, self.texts, self.sizes))
        out, places = dataset, []
        for i, (text, small) in enumerate(zip(texts, self.getOrDefault(self.sent))):
            places.append(f"_place_{i}")
            rows = self.dictionary.filter(F.col("column") == i).select("category", F.col("place").alias(places[-1]))
            out = looked_up(out, rows, bool(small), text, "category")
        width = len(numbers) + sum(sizes)
        first = np.cumsum([len(numbers), *sizes[:-1]]) if sizes else np.zeros(0, "i8")

        @F.arrow_udf(VectorUDT())
        def vector(*columns: pa.Array) -> pa.Array:
            rows = len(columns[0])
            values, at = np.ones((rows, len(columns))), np.zeros((rows, len(columns)), "i4")
            held = np.ones((rows, len(columns)), bool)
            for k, column in enumerate(columns):
                if k < len(numbers):
                    values[:, k], at[:, k] = column.to_numpy(zero_copy_only=False), k
                else:
                    held[:, k] = column.is_valid().to_numpy(zero_copy_only=False)
                    at[:, k] = column.fill_null(0).to_numpy(zero_copy_only=False) + first[k - len(numbers)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(held.sum(1))]).astype("i4"))
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(rows, "i1")), pa.array(np.full(rows, width, "i4")),
                    pa.ListArray.from_arrays(offsets, pa.array(at[held])), pa.ListArray.from_arrays(offsets, pa.array(values[held])),
                ],
                ["type", "size", "indices", "values"],
            )

        made = vector(*[F.col(c).cast("double") for c in numbers], *[F.col(c) for c in places])
        return out.withColumn(self.getOrDefault(self.output), made).drop(*places)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: FeatureVector):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.dictionary.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> FeatureVector:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = FeatureVector(dictionary=self.sparkSession.read.parquet(f"{path}/dictionary"))
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        return stage


@dataclass
class CategoryTable:
    """Categories of several columns: the dictionary, and per column its most frequent category,
    its number of categories and whether its part of the dictionary is small."""

    dictionary: DataFrame
    most_frequent: list[str]
    sizes: list[int]
    small: list[bool]


def category_table(counted: DataFrame, columns: Sequence[int]) -> CategoryTable:
    """From ``column, category, n``: the dictionary of the columns, renumbered in the given order."""
    order = {c: i for i, c in enumerate(columns)}
    facts = counted.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("category")).alias("letters"), F.min(F.struct(-F.col("n"), "category")).alias("top")
    )
    facts = {order[r["column"]]: r for r in facts.collect()}  # a row per column
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = counted.select(place[F.col("column")].alias("column"), "category")
    dictionary = numbered(rows, ["column", "category"], "place", within="column").checkpoint()
    known = [facts[i] for i in range(len(order))]
    return CategoryTable(
        dictionary, [r["top"]["category"] for r in known], [r["rows"] for r in known],
        [r["letters"] + ROW_BYTES * r["rows"] <= BROADCAST_BYTES for r in known],
    )


def names_of(spark: SparkSession, numbers: Sequence[str], columns: Sequence[str], table: CategoryTable, wanted: Sequence[int]) -> dict[int, str]:
    """Names of some places of the vector."""
    out = {i: f"numeric__{numbers[i]}" for i in wanted if i < len(numbers)}
    first = np.cumsum([len(numbers), *table.sizes])
    asked = []
    for i in wanted:
        if i >= len(numbers):
            column = int(np.searchsorted(first, i, side="right")) - 1
            asked.append((i, column, int(i - first[column])))
    if asked:
        rows = spark.createDataFrame(asked, "i bigint, column int, place bigint")
        for r in table.dictionary.join(F.broadcast(rows), ["column", "place"]).collect():
            out[r["i"]] = f"categorical__{columns[r['column']]}_{r['category']}"
    return out
