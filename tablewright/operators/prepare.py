"""From a table and a target to features a model can be fitted on."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    STRING,
    as_double,
    category_text,
    col,
    kind_of,
    kinds,
    tidy,
)
from tablewright.operators.dictionary import (
    CategoryTable,
    FeatureVector,
    category_table,
    class_dictionary,
    looked_up,
    names_of,
    size_of,
)
from tablewright.operators.profile import column_profile
from tablewright.operators.quantiles import quantiles_and_more
from tablewright.operators.split import hash_name, row_hash
from tablewright.operators.summary import IN_MEMORY_VALUES
from tablewright.session import ensure_checkpoint_dir

MINIMUM_ROWS = 10
HIGH_CARDINALITY = 0.95

#: classes, and categories in all, up to these numbers are listed in the model; more are
#: numbered in tables and joined to the rows
HELD_CLASSES = 10_000
HELD_CATEGORIES = 10_000
#: longest text, in bytes, that is listed in the model
HELD_LENGTH = 1024

LABEL = "_label"
FEATURES = "_features"


@dataclass
class Prepared:
    """Rows with a usable target, their label column, and which columns are features.

    A classification has either ``classes``, in order of label, or, of too many to list, a
    ``class_table`` (``class``, ``label``); ``class_count`` is 0 for a regression.
    """

    frame: DataFrame
    target: str
    task_type: str
    classes: list[str] | None
    rows: int
    numeric: list[str]
    categorical: list[str]
    dropped: list[str]
    key: list[str] | None = None
    features: list[str] = field(default_factory=list)
    class_table: DataFrame | None = None
    class_count: int = 0


def detect_task(kind: str, distinct: int) -> str:
    return "classification" if kind in (STRING, BOOLEAN) or distinct <= 5 else "regression"


def prepare(
    df: DataFrame, target: str, key: Sequence[str] | None = None, distinct: str = "auto", held_classes: int = HELD_CLASSES
) -> Prepared:
    """Drop rows without a target and text columns of mostly distinct values, detect the
    task and encode the target.

    ``key`` names columns that identify a row; they are used for splitting and are still
    features unless dropped by the rule above. More than ``held_classes`` classes are
    numbered in a table.
    """
    df = tidy(df)
    target = target.strip()
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found; columns are {df.columns}")
    labelled = df.filter(col(target).isNotNull())
    facts = {r["column"]: r for r in column_profile(labelled, distinct).collect()}
    goal = facts[target]
    rows = goal["rows"]
    if rows < MINIMUM_ROWS and df.count() < MINIMUM_ROWS:
        raise ValueError(f"training needs at least {MINIMUM_ROWS} rows")
    dropped = [
        c for c, f in facts.items()
        if c != target and f["kind"] == STRING and f["distinct"] / max(rows, 1) > HIGH_CARDINALITY
    ]
    features = [c for c in df.columns if c != target and c not in dropped and facts[c]["kind"] != "nested"]
    if not features:
        raise ValueError("no usable feature columns")
    task = detect_task(goal["kind"], goal["distinct"])
    types = {f.name: f.dataType for f in df.schema.fields}
    classes, class_table, class_count = None, None, 0
    if task == "classification":
        text = category_text(target, types[target])
        named = labelled.withColumn("_label_text", text)
        few = goal["distinct"] <= held_classes
        if few and goal["distinct"] > 2:  # texts of any length may not be listed
            few = (named.agg(F.max(F.octet_length("_label_text"))).first()[0] or 0) <= HELD_LENGTH
        if few:
            classes = sorted(r[0] for r in named.select("_label_text").distinct().collect())
            class_count = len(classes)
            # the label carries its classes, also those that a part of the rows lacks
            place = StringIndexerModel.from_labels(classes, inputCol="_label_text", outputCol=LABEL, handleInvalid="error")
            encoded = place.transform(named).drop("_label_text")
        else:
            class_table = class_dictionary(named.select("_label_text"))
            size = size_of(class_table, "class")
            class_count = size.rows
            numbers = class_table.withColumnRenamed("label", LABEL)
            if key:  # hashed before the join, so that a split need not move the key
                named = named.withColumn(hash_name(key), row_hash(key))
            encoded = looked_up(named, numbers, size.small, "_label_text", "class").drop("_label_text")
        if class_count < 2:
            raise ValueError("classification needs at least 2 target classes")
    else:
        encoded = labelled.withColumn(LABEL, as_double(target, types[target])).filter(F.col(LABEL).isNotNull())
        if kind_of(types[target]) != NUMERIC:
            rows = encoded.count()
    if rows < MINIMUM_ROWS:
        raise ValueError("too few rows with a usable target")
    filled = {c for c in features if facts[c]["missing"] < facts[c]["rows"]}
    return Prepared(
        frame=encoded,
        target=target,
        task_type=task,
        classes=classes,
        rows=rows,
        numeric=[c for c in features if facts[c]["kind"] == NUMERIC and c in filled],
        categorical=[c for c in features if facts[c]["kind"] in (STRING, BOOLEAN, DATETIME) and c in filled],
        dropped=dropped,
        key=list(key) if key else None,
        features=features,
        class_table=class_table,
        class_count=class_count,
    )


@dataclass
class NumericFit:
    name: str
    median: float
    mean: float
    scale: float
    low: float
    high: float


def fit_numeric(df: DataFrame, names: Sequence[str]) -> list[NumericFit]:
    """Median for missing values, then mean and population deviation of the filled column.

    The filled column's moments follow from the present values' moments, the missing
    count and the median, so filling needs no pass of its own.
    """
    if not names:
        return []
    values = df.select(*[col(c).cast("double").alias(c) for c in names])
    facts = []
    for i, c in enumerate(names):
        x = col(c)
        facts += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"),
            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
        ]
    seen = values.agg(F.count(F.lit(1)).alias("rows"), *facts).first()
    rows = seen["rows"]
    if rows * len(names) <= IN_MEMORY_VALUES:
        row = values.agg(*[F.percentile(col(c), F.lit(0.5)).alias(f"q{i}") for i, c in enumerate(names)]).first()
        medians = {c: row[f"q{i}"] for i, c in enumerate(names)}
    else:
        medians = {
            c: q[0] for c, q in quantiles_and_more(values, names, [0.5], (), rows=rows)[0].items()
        }
    out = []
    for i, c in enumerate(names):
        present, median = seen[f"n{i}"], medians[c]
        if not present:
            continue  # nothing to fill from
        absent = rows - present
        mean = (present * seen[f"m{i}"] + absent * median) / rows
        spread = present * (seen[f"v{i}"] + (seen[f"m{i}"] - mean) ** 2) + absent * (median - mean) ** 2
        varies = seen[f"lo{i}"] != seen[f"hi{i}"]
        scale = math.sqrt(spread / rows) if varies else 1.0
        if not varies:
            mean = median
        out.append(NumericFit(c, median, mean, scale or 1.0, seen[f"lo{i}"], seen[f"hi{i}"]))
    return out


@dataclass
class CategoryFit:
    name: str
    most_frequent: str
    categories: list[str]


def count_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column`` (place in ``names``), ``category``, ``n``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*[category_text(c, types[c]).alias(f"c{i}") for i, c in enumerate(names)])
    return (
        texts.unpivot([], texts.columns, "place", "category")
        .filter(F.col("category").isNotNull())
        .groupBy(F.substring("place", 2, 10).cast("int").alias("column"), "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _listed(counted: DataFrame, names: Sequence[str], held: int) -> list[CategoryFit] | None:
    """Per column with values what was counted; None for more categories than ``held``, or
    longer ones than can be listed."""
    short = F.when(F.octet_length("category") <= HELD_LENGTH, F.col("category"))
    listed = counted.select("column", short.alias("category"), "n").limit(held + 1).collect()
    if len(listed) > held or any(r["category"] is None for r in listed):
        return None
    out = []
    for i, name in enumerate(names):
        mine = [(r["category"], r["n"]) for r in listed if r["column"] == i]
        if mine:
            top = min(mine, key=lambda p: (-p[1], p[0]))[0]
            out.append(CategoryFit(name, top, sorted(c for c, _ in mine)))
    return out


def fit_categories(df: DataFrame, names: Sequence[str], held: int = HELD_CATEGORIES) -> list[CategoryFit] | None:
    """Most frequent category (ties to the smallest) and the sorted categories per column; None
    where there are too many to list, which ``fit_features`` keeps in a table."""
    return _listed(count_categories(df, names), names, held) if names else []


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _text(value: str) -> str:
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + quoted.replace("${", "$' '{") + "'"  # kept from variable substitution


@dataclass
class FeatureMap:
    """Fitted preparation: stages that turn raw columns into one feature vector.

    Categories are listed in ``categorical`` or, where they are too many, numbered in
    ``table``, whose columns are ``wide``.
    """

    stages: list[Transformer]
    numeric: list[NumericFit]
    categorical: list[CategoryFit]
    wide: list[str] = field(default_factory=list)
    table: CategoryTable | None = None

    @property
    def model(self) -> PipelineModel:
        return PipelineModel(stages=self.stages)

    @property
    def width(self) -> int:
        listed = sum(len(f.categories) for f in self.categorical)
        return len(self.numeric) + listed + (sum(self.table.sizes) if self.table else 0)

    @property
    def groups(self) -> list[int]:
        """How many features each column of categories has; they follow those of the numbers."""
        return list(self.table.sizes) if self.table else [len(f.categories) for f in self.categorical]

    @property
    def names(self) -> list[str]:
        """Names of all features, where categories are listed."""
        if self.table:
            raise ValueError("the categories are in a table; ask for the names of single places")
        listed = [f"categorical__{f.name}_{c}" for f in self.categorical for c in f.categories]
        return [f"numeric__{f.name}" for f in self.numeric] + listed

    def names_of(self, spark, wanted: Sequence[int]) -> dict[int, str]:
        """Names of some features by their place."""
        if self.table is None:
            names = self.names
            return {i: names[i] for i in wanted}
        return names_of(spark, [f.name for f in self.numeric], self.wide, self.table, wanted)


def fit_features(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], held: int = HELD_CATEGORIES
) -> FeatureMap:
    """Median fill and standardising for numbers, most-frequent fill and one-hot for the
    rest; a category not seen in training becomes all zeros.

    Up to ``held`` categories in all, every stage is built in, so the fitted preparation
    saves, loads and runs inside the JVM. More are numbered in a table that is joined to the
    rows and saved with the model.
    """
    numbers = fit_numeric(train, numeric)
    labels, wide, found = [], [], None
    if categorical:
        counted = count_categories(train, categorical)
        labels = _listed(counted, categorical, held)
        if labels is None:
            ensure_checkpoint_dir(train.sparkSession)
            counted, labels = counted.checkpoint(), []
            present = sorted(r[0] for r in counted.select("column").distinct().collect())
            wide = [categorical[i] for i in present]
            found = category_table(counted, present)
    kind = kinds(train)
    select = ["*"]
    for i, f in enumerate(numbers):
        filled = f"coalesce(nanvl(try_cast({_quoted(f.name)} AS DOUBLE), NULL), {_number(f.median)})"
        select.append(f"({filled} - {_number(f.mean)}) / {_number(f.scale)} AS _num_{i}")
    fills = [(f.name, f.most_frequent) for f in labels] or list(zip(wide, found.most_frequent if found else []))
    for i, (name, fill) in enumerate(fills):
        quoted = _quoted(name)
        text = f"CAST({quoted} AS STRING)"
        if kind[name] == BOOLEAN:
            text = f"CASE WHEN {quoted} THEN 'True' WHEN NOT {quoted} THEN 'False' END"
        select.append(f"coalesce({text}, {_text(fill)}) AS _cat_{i}")
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT {', '.join(select)} FROM __THIS__")]
    inputs = [f"_num_{i}" for i in range(len(numbers))]
    if found:
        texts = [f"_cat_{i}" for i in range(len(wide))]
        sent = [int(small) for small in found.small]
        stages.append(FeatureVector(inputs, texts, found.sizes, sent, FEATURES, found.dictionary))
        return FeatureMap(stages, numbers, [], wide, found)
    if labels:
        places = range(len(labels))
        # the index of an unseen category is the last one, which the encoder leaves out
        indexers = [
            StringIndexerModel.from_labels(
                f.categories, inputCol=f"_cat_{i}", outputCol=f"_idx_{i}", handleInvalid="keep"
            )
            for i, f in enumerate(labels)
        ]
        encoder = OneHotEncoder(
            inputCols=[f"_idx_{i}" for i in places], outputCols=[f"_hot_{i}" for i in places], dropLast=True
        )
        shaped = stages[0].transform(train.limit(0))
        for indexer in indexers:
            shaped = indexer.transform(shaped)
        stages += [*indexers, encoder.fit(shaped)]  # sizes come from the indexers, not from rows
        inputs += [f"_hot_{i}" for i in places]
    if not inputs:
        raise ValueError("no usable feature columns")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
    return FeatureMap(stages, numbers, labels)
