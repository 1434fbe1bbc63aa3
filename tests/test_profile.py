"""Profiling against pandas and by hand, with values spread over several slices."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.operators import profile, ranks


def by_column(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, some are missing, one column is constant."""
    rng = np.random.default_rng(7)
    n = 3000
    a = np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 100, n))
    b = np.where(rng.random(n) < 0.2, np.nan, 3 * a + rng.normal(0, 10, n))
    frame = pd.DataFrame(
        {"g": rng.choice(["x", "y", "z"], n, p=[0.9, 0.08, 0.02]), "a": a, "b": b, "c": 0.1}
    )
    return frame, spark.createDataFrame(frame, "g string, a double, b double, c double")


def test_describe_equals_pandas(spark, skewed, many_slices):
    frame, df = skewed
    rows = by_column(profile.describe(df, ["a", "b", "c"]))
    expected = frame[["a", "b", "c"]].describe()
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    for c in "abc":
        assert [rows[c][n] for n in names] == pytest.approx(list(expected[c]), rel=1e-9, abs=1e-9)


def test_running_totals_over_several_slices(spark, skewed, many_slices):
    _, df = skewed
    counts = df.groupBy("a").agg(F.count("*").alias("n"))
    slices = counts.repartitionByRange("a").select(F.spark_partition_id().alias("s"))
    assert slices.distinct().count() > 1
    running = 0
    for row in ranks.running_totals(counts, [], ["a"], ["n"]).orderBy("a").collect():
        assert row.n_before == running and row.n_total == 3000
        running += row.n
    assert running == 3000


def test_quantiles_from_narrow_brackets(spark, skewed, many_slices):
    frame, df = skewed
    rows = by_column(profile.describe(df, ["a", "b", "c"]))
    for c in "abc":
        expected = frame[c].quantile([0.25, 0.5, 0.75])
        found = [rows[c].q25, rows[c].q50, rows[c].q75]
        assert found == pytest.approx(list(expected), rel=1e-9, abs=1e-9)
    boxes = {r.g: r for r in profile.box_stats(df, "g", ["a"]).collect()}
    for g, part in frame.groupby("g"):
        expected = part.a.quantile([0.25, 0.5, 0.75])
        found = [boxes[g].q25, boxes[g].q50, boxes[g].q75]
        assert found == pytest.approx(list(expected), rel=1e-9, abs=1e-9)


def test_narrow_brackets_leave_few_values_to_rank(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("a"))
    sketched = ranks.bracketed(ranks.sketches(df, ["a"]), {"m": 0.5})
    brackets = ranks._brackets(sketched, ["column"], 1)
    ranked = ranks._ranked(ranks.melt(df, ["a"]), ["column"], brackets, 1)
    assert ranked.count() <= 110
    assert ranked.agg(F.sum("n")).first()[0] == 10_000
    assert ranks.quantiles(df, ["a"], {"m": 0.5}).first().m == 4999.5


def test_quantiles_outside_wrong_brackets_are_found_anyway(spark):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("a"))
    columns = "column string, n long, edges array<double>"
    wrong = spark.createDataFrame([("a", 1000, [5.0, 6.0])], columns)
    assert ranks.quantiles(df, ["a"], {"m": 0.5}, sketched=wrong).first().m == 499.5


def test_sketches_merge_their_slots(spark, many_slices):
    """Moments far from zero, over several slots, a group with no values and one with one."""
    df = spark.range(0, 20_000, 1, 11).selectExpr(
        "IF(id < 2, 'few', 'many') AS g", "IF(id = 0, NULL, 1e9 + id) AS a",
        "CAST(NULL AS DOUBLE) AS b",
    )
    rows = {(r.g, r["column"]): r for r in ranks.sketches(df, ["a", "b"], "g").collect()}
    many, few = rows["many", "a"], rows["few", "a"]
    values = 1e9 + np.arange(2, 20_000)
    assert (many.n, many.min, many.max) == (19_998, values.min(), values.max())
    assert many.mean == pytest.approx(values.mean(), rel=1e-14)
    assert many.std == pytest.approx(values.std(ddof=1), rel=1e-10)
    assert (few.n, few.mean, few.std) == (1, 1e9 + 1, None)
    assert (rows["few", "b"].n, rows["few", "b"].mean, rows["few", "b"].max) == (0, None, None)
    sizes = [r[0] for r in df.groupBy("g").count().select("count").collect()]
    assert sorted(sizes) == [2, 19_998]
    found = {r.g: r.m for r in ranks.quantiles(df, ["a"], {"m": 0.5}, "g").collect()}
    assert found == {"few": 1e9 + 1, "many": float(np.median(values))}


def test_describe_sketch_is_close(spark, skewed):
    frame, df = skewed
    row = by_column(profile.describe(df, ["a"], accuracy=10_000))["a"]
    assert row.q25 in set(frame.a)
    assert row.q25 == pytest.approx(frame.a.quantile(0.25), abs=5)


def test_describe_empty_and_single(spark):
    empty = spark.createDataFrame([], "a double")
    row = profile.describe(empty, ["a"]).first()
    assert row["count"] == 0 and row.q50 is None and row.mean is None
    one = profile.describe(spark.createDataFrame([(4.0,)], "a double"), ["a"]).first()
    assert (one.q25, one.q50, one["min"], one.std) == (4.0, 4.0, 4.0, None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6) | st.none(), min_size=1, max_size=30))
def test_quartiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    known = [v for v in values if v is not None]
    row = profile.describe(df, ["a"]).first()
    expected = np.percentile(known, [25, 50, 75]) if known else [None] * 3
    for ours, theirs in zip([row.q25, row.q50, row.q75], expected):
        assert ours == (pytest.approx(theirs, rel=1e-9, abs=1e-9) if known else None)


def test_correlation_equals_pandas(spark, skewed):
    frame, df = skewed
    matrix = profile.correlation_matrix(df, ["a", "b", "c"])
    pairs = {(r.x, r.y): r["corr"] for r in matrix.collect()}
    expected = frame[["a", "b"]].corr()
    assert len(pairs) == 9
    for x in "ab":
        for y in "ab":
            assert pairs[x, y] == pytest.approx(expected.loc[x, y], abs=1e-12)
            assert pairs[x, y] == pairs[y, x]
    assert all(pairs[p] is None for p in pairs if "c" in p)


def test_correlation_constant_where_both_are_present(spark):
    rows = [(1.0, 1.0), (1.0, 2.0), (7.0, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    pairs = {(r.x, r.y): r["corr"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert pairs["a", "b"] is None and pairs["a", "a"] == pytest.approx(1.0)
    nothing = profile.correlation_matrix(spark.createDataFrame([], "a double"), ["a"]).collect()
    assert [tuple(r) for r in nothing] == [("a", "a", None)]


def test_boxes_by_hand(spark, many_slices):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    rows = [("p", v) for v in values] + [("q", 5.0), (None, 9.0), ("q", math.nan), ("q", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    boxes = {r.g: r for r in profile.box_stats(df, "g", ["v"]).collect()}
    p = boxes["p"]
    assert (p.n, p.q25, p.q50, p.q75, p.low_whisker, p.high_whisker, p.outliers) == (
        5, 2.0, 3.0, 4.0, 1.0, 4.0, 1,
    )
    assert (boxes["q"].n, boxes["q"].low_whisker, boxes["q"].outliers) == (1, 5.0, 0)
    assert set(boxes) == {"p", "q"}
    out = profile.box_outliers(df, "g", "v").collect()
    assert [(r.g, r.v, r.high_fence) for r in out] == [("p", 100.0, 7.0)]


def test_whisker_never_inside_the_box(spark):
    # The highest value is an outlier and the next lies below the third quartile.
    df = spark.createDataFrame([(1, v) for v in (0.0, 0.0, 0.0, 1.0, 9.0, 9.0)], "g int, v double")
    box = profile.box_stats(df, "g", ["v"], k=0.1).first()
    assert box.high_whisker == box.q75 and box.low_whisker <= box.q25


def test_counts_and_shape(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", math.nan), ("a", None), (None, 2.0), ("b", 3.0), ("c", 1.0)],
        "k string, v double",
    )
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [
        ("a", 2), ("b", 2), ("c", 1),
    ]
    assert tuple(profile.shape(df).first()) == (6, 2)
    missing = {r["column"]: r.missing for r in profile.missing_counts(df).collect()}
    assert missing == {"k": 1, "v": 2}
    info = [tuple(r) for r in profile.column_info(df).collect()]
    assert info == [(0, "k", 5, "string"), (1, "v", 4, "double")]
    assert profile.numeric_columns(spark.createDataFrame([], S.TELEMETRY)) == [
        *S.NUMERIC_FEATURES, "Failed",
    ]
    assert [r.v for r in profile.head(df.where("v > 0"), "v", 2).collect()] == [1.0, 1.0]


def test_no_merge_reads_many_sketches(spark):
    """A hundred slots meet ten by ten."""
    assert [ranks.fan_in(n) for n in (1, 4, 100, 20_000)] == [1, 2, 10, 142]
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, 100)
    try:
        df = spark.range(0, 30_000, 1, 120).selectExpr("CAST(id * 7919 % 30000 AS DOUBLE) AS x", "id % 2 AS g")
        rows = ranks.sketches(df, ["x"], ["g"])
        found = {r.g: r for r in rows.collect()}
        exact = df.groupBy("g").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.count("x").alias("n")).collect()
        for r in exact:
            got = found[r.g]
            assert got.n == r.n and abs(got["mean"] - r.m) < 1e-6 and abs(got["std"] - r.s) < 1e-6
        quartiles = ranks.quantiles(df, ["x"], {"q": 0.5}).first()
        assert quartiles.q == 14_999.5
    finally:
        spark.conf.set(name, before)
