import math
import random

import numpy as np
import pandas as pd
import pytest

from tablewright.operators.charts import bin_edges, histogram, line_series, missing_chart, top_groups
from tablewright.operators.correlation import correlation_matrix
from tablewright.operators.profile import column_classes, column_profile, parse_aware_classes
from tablewright.operators.quality import table_quality
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.summary import categorical_summary, category_counts, numeric_summary


def test_nan_is_missing_and_counts_ignore_it(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a")], "x double, s string")
    facts = {r["column"]: r for r in column_profile(df).collect()}
    assert (facts["x"]["missing"], facts["x"]["distinct"]) == (2, 1)
    assert (facts["s"]["missing"], facts["s"]["distinct"]) == (1, 1)


def test_sketched_profile_decides_like_the_exact_one(spark):
    df = spark.range(5000).selectExpr(
        "id", "cast(id % 5 as string) five", "id % 21 as many", "cast(id as string) key",
        "cast(least(id, 4750) as string) edge", "cast(null as double) none",
    )
    exact = {r["column"]: r["distinct"] for r in column_profile(df, "exact").collect()}
    sketch = {r["column"]: r["distinct"] for r in column_profile(df, "sketch").collect()}
    assert exact["edge"] == 4751 == sketch["edge"]  # a share right above 0.95
    for c in ("five", "many", "none"):
        assert exact[c] == sketch[c]
    assert abs(sketch["key"] - 5000) < 125


def test_text_rule(spark):
    long = [(i, "x" * 50 + str(i), "y" * 50) for i in range(40)]
    df = spark.createDataFrame(long, "k int, t string, u string")
    classes = {r["column"]: r["column_class"] for r in column_classes(df).collect()}
    assert classes == {"k": "numeric", "t": "text", "u": "categorical"}
    mixed = [(i, ("long " * 20 if i < 30 else "s") + str(i)) for i in range(1000)]
    df = spark.createDataFrame(mixed, "k int, t string")
    assert {r["column"]: r["column_class"] for r in column_classes(df).collect()}["t"] == "categorical"
    assert {r["column"]: r["column_class"] for r in column_classes(df, ["k"]).collect()}["t"] == "text"


def test_nested_and_boolean_columns(spark):
    df = spark.createDataFrame([([1], True), ([2], None)], "a array<int>, b boolean")
    classes = {r["column"]: r["column_class"] for r in column_classes(df).collect()}
    assert classes == {"a": "nested", "b": "categorical"}
    assert [r["category"] for r in category_counts(df, ["b"]).collect()] == ["True", "nan"]


def test_dates_in_text(spark):
    rows = [("2024-01-01", "x")] * 8 + [(None, "x")] * 2
    df = spark.createDataFrame(rows, "d string, c string")
    found = {r["column"]: r["column_class"] for r in parse_aware_classes(df).collect()}
    assert found == {"d": "datetime", "c": "categorical"}
    df = spark.createDataFrame([("2024-01-01", "x")] * 7 + [(None, "x")] * 3, "d string, c string")
    assert parse_aware_classes(df).filter("column = 'd'").first()["column_class"] == "categorical"  # 0.7 is not above 0.7


@pytest.mark.parametrize("compare", ["digest", "values"])
def test_duplicates(spark, compare):
    rows = [("a", None), (None, "a"), ("a", None), (None, None), (None, None), (None, None), ("a", "a")]
    row = table_quality(spark.createDataFrame(rows, "x string, y string"), compare).first()
    assert (row["rows"], row["missing_cells"], row["duplicate_rows"]) == (7, 9, 3)
    assert row["quality_score"] == round(100 - 45 * 9 / 14 - 25 * 3 / 7, 2)


def test_one_row_over_a_third_of_the_table(spark):
    df = spark.range(9000).selectExpr("if(id < 3000, 0, id) as k", "if(id < 3000, 'hot', cast(id as string)) as s")
    assert table_quality(df).first()["duplicate_rows"] == 2999


def test_empty_table_quality(spark):
    row = table_quality(spark.createDataFrame([], "a int")).first()
    assert (row["rows"], row["duplicate_rows"], row["quality_score"]) == (0, 0, 100.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranked_quantiles_match_numpy(spark, seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(4000):
        rows.append((draw.gauss(0, 1), float(draw.randint(0, 3)), 7.0 if draw.random() < 0.4 else draw.uniform(0, 20), None))
    rows += [(None, None, None, None)] * 100
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    # a coarse sketch and a tiny ranking bound force the narrowing rounds
    found = exact_quantiles(df, ["a", "b", "c", "d"], points, accuracy=50, ranked_values=20)
    for i, c in enumerate("abc"):
        want = np.quantile([r[i] for r in rows if r[i] is not None], points)
        assert np.allclose(found[c], want, rtol=0, atol=1e-12)
    assert found["d"] == [None] * len(points)


def test_numeric_summary_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5)], "one double, none double, k int")
    rows = {r["column"]: r for r in numeric_summary(df).collect()}
    assert set(rows) == {"one", "k"}
    assert rows["one"]["std"] is None and rows["one"]["median"] == 1.0
    spread = {r["column"]: r for r in numeric_summary(df, single_value_spread=0.0).collect()}
    assert spread["one"]["std"] == 0.0 and spread["one"]["variance"] == 0.0


def test_category_ties_and_missing(spark):
    rows = [("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,), ("c",)]
    df = spark.createDataFrame(rows, "s string")
    row = categorical_summary(df).first()
    assert (row["top_value"], row["top_frequency"], row["distinct"], row["missing"]) == ("nan", 3, 3, 3)
    assert [tuple(c) for c in row["top_categories"]] == [("nan", 3), ("a", 2), ("b", 2), ("c", 1)]
    row = categorical_summary(df, keep_missing=False).first()
    assert (row["top_value"], row["top_frequency"]) == ("a", 2)
    assert categorical_summary(df.filter("s is null"), keep_missing=False).count() == 0


def test_histogram_matches_numpy(spark):
    draw = np.random.default_rng(5)
    for values in (draw.normal(size=200), np.array([3.0] * 7), np.arange(23.0), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        bins = min(8, max(3, len(values) // 5))
        counts, edges = np.histogram(values, bins=bins)
        rows = sorted(histogram(df).collect(), key=lambda r: r["bin"])
        assert [r["count"] for r in rows] == list(counts)
        assert np.allclose([r["low"] for r in rows] + [rows[-1]["high"]], edges)
    assert histogram(spark.createDataFrame([(1.0,)], "x double")).count() == 0
    assert bin_edges(2.0, 2.0, 3)[0] == 1.5


def test_correlation_matches_pandas(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=300)
    frame = pd.DataFrame({"a": base, "b": base * 2 + draw.normal(size=300), "c": draw.normal(size=300) + 1e6, "k": 0.1})
    frame.loc[frame.index % 3 == 0, "b"] = np.nan
    frame.loc[5, "c"] = np.inf
    want = frame.corr().fillna(0)
    df = spark.createDataFrame(frame)
    found = {(r["x"], r["y"]): r["value"] for r in correlation_matrix(df).collect()}
    for x in frame:
        for y in frame:
            assert math.isclose(found[(x, y)], want.loc[y, x], abs_tol=1e-9), (x, y)


def test_wide_table_correlation(spark):
    draw = np.random.default_rng(9)
    frame = pd.DataFrame(draw.normal(size=(120, 45)) + 1e4, columns=[f"c.{i}" for i in range(45)])
    frame["c.1"] = frame["c.0"] * 2
    frame["c.2"] = 5.0
    frame.loc[3, "c.4"] = np.nan
    want = frame.corr().fillna(0)
    found = {(r["x"], r["y"]): r["value"] for r in correlation_matrix(spark.createDataFrame(frame)).collect()}
    assert len(found) == 45 * 45
    assert all(math.isclose(found[(x, y)], want.loc[y, x], abs_tol=1e-9) for x in frame for y in frame)


def test_small_charts(spark):
    df = spark.createDataFrame([(3, 1.0, "a"), (1, 2.0, None), (2, None, "b")], "k int, x double, g string")
    assert [(r["index"], r["value"]) for r in line_series(df, ["k"], ["x"]).collect()] == [(0, 2.0), (1, 1.0)]
    assert {r["column"]: r["missing"] for r in missing_chart(df).collect()} == {"x": 1, "g": 1}
    assert [tuple(r) for r in top_groups(df, "g", "x").collect()] == [("a", 1.0), ("b", None)]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as g", "cast(id % 3 as string) as s", "sqrt(id) as x")
    def facts(frame):
        return (
            sorted(map(str, categorical_summary(frame).collect())),
            sorted((r["column"], r["median"], round(r["mean"], 9)) for r in numeric_summary(frame, quantiles="ranked").collect()),
            table_quality(frame).collect(),
            sorted(map(str, histogram(frame).collect())),
        )
    assert facts(df.repartition(1)) == facts(df.repartition(13))


def test_wide_table_with_gaps(spark):
    draw = np.random.default_rng(4)
    frame = pd.DataFrame(draw.normal(size=(300, 60)), columns=[f"c{i}" for i in range(60)])
    frame = frame.mask(draw.random(frame.shape) < 0.1)
    want = frame.corr()
    found = correlation_matrix(spark.createDataFrame(frame)).collect()
    assert len(found) == 3600
    assert all(math.isclose(r["value"], want.loc[r["x"], r["y"]], abs_tol=1e-9) for r in found)


def test_quartiles_with_infinite_ends(spark):
    df = spark.createDataFrame([(float("-inf"),), (float("-inf"),), (1.0,), (2.0,)], "x double")
    ways = [numeric_summary(df, quantiles=q).select("q1", "median", "q3").first() for q in ("memory", "ranked")]
    assert ways[0] == ways[1]


def test_texts_are_no_categories(spark):
    rows = [(f"a long text that nobody would take for a category, number {i}", "ab"[i % 2]) for i in range(20)]
    found = {r["column"] for r in categorical_summary(spark.createDataFrame(rows, "t string, c string")).collect()}
    assert found == {"c"}
