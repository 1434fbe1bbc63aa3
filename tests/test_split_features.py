"""Splits, weights, scaling, encoding and validation."""

import math

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.operators import features, quality, split
from devicepulse.session import kept, match
from devicepulse.sources.telemetry import device_rows


def test_split_is_exact_disjoint_and_whole(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    train, test = split.stratified_split(df, "id", "y")
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b and len(a | b) == 1003
    sizes = {r.y: r.n for r in test.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {1: round(0.2 * 144), 0: round(0.2 * 859)}
    assert train.columns == df.columns
    again = {r.id for r in split.stratified_split(df.repartition(5), "id", "y")[1].collect()}
    other = {r.id for r in split.stratified_split(df, "id", "y", seed=1)[1].collect()}
    assert again == b and other != b


@pytest.mark.parametrize("digits", [1, 2, 8])
def test_split_does_not_depend_on_the_digits(spark, digits):
    df = spark.range(500).withColumn("y", F.col("id") % 2)
    base = split.mark_test(df, "id", "y").where(split.TEST)
    same = split.mark_test(df, "id", "y", digits=digits).where(split.TEST)
    assert {r.id for r in same.collect()} == {r.id for r in base.collect()}


def test_split_keeps_null_labels_and_copies_together(spark):
    rows = [(i, None if i % 5 == 0 else 1) for i in range(100)] + [(1, 1)] * 50
    df = spark.createDataFrame(rows, "id int, y int")
    flagged = split.mark_test(df, "id", "y")
    assert flagged.count() == 150
    sides = flagged.groupBy("id").agg(F.count_distinct(split.TEST).alias("n"))
    assert sides.where("n > 1").count() == 0
    counts = {r.y: (r.n_train, r.n_test) for r in split.split_counts(df, "id", "y").collect()}
    assert counts[None] == (16, 4)


def test_split_by_two_keys_and_small_classes(spark):
    rows = [("a", i, int(i < 2)) for i in range(22)]
    df = spark.createDataFrame(rows, "k string, i int, y int")
    counts = {r.y: r.n_test for r in split.split_counts(df, ["k", "i"], "y").collect()}
    assert counts == {0: 4, 1: 0}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "y int")
    rows = split.balanced_weights(df, "y").collect()
    weights = {r.y: r.class_weight for r in rows}
    assert len(rows) == 9
    assert weights == {0: 8 / (2 * 6), 1: 8 / (2 * 2), None: None}


def test_kept_side_is_broadcast_by_its_size_alone(spark):
    left = spark.range(200).withColumn("k", F.col("id") % 20)
    small = kept(left.groupBy("k").agg(F.count("*").alias("n")))
    plan = match(left, small, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("groups", [1, 10_001, 100_001])
def test_kept_sides_of_any_size_match_alike(spark, groups):
    df = spark.range(groups).withColumn("y", F.col("id"))
    rows = split.balanced_weights(df, "y")
    assert rows.where("class_weight = 1").count() == groups


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", ["7", None])
def test_split_is_exact_with_a_hot_key(spark, seed, hot):
    rows = [(hot if i % 5 < 3 else str(i), i, int(i % 4 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int, y int")
    counts = split.split_counts(df, "k", "y", seed=seed).collect()
    assert {r.y: (r.n_train, r.n_test) for r in counts} == {0: (600, 150), 1: (200, 50)}
    sides = split.mark_test(df, "k", "y", seed=seed, together=True)
    mixed = sides.groupBy("k", "y").agg(F.count_distinct(split.TEST).alias("n")).where("n > 1")
    assert mixed.isEmpty()


def test_split_tells_null_places_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 1)] * 1, "k string, l string, y int")
    assert split.split_counts(df, ["k", "l"], "y", test_size=0.5).first().n_test == 1


def test_one_device_type_can_be_fitted_and_others_are_refused(spark):
    df = device_rows(spark, [{"CPU_Usage": float(i), "Device_Type": "Router"} for i in range(4)])
    model = features.fit_features(df)
    assert [len(r.features) for r in model.transform(df).collect()] == [9] * 4
    other = device_rows(spark, [{"Device_Type": "Switch"}])
    with pytest.raises(Py4JJavaError, match="Unseen label: Switch"):
        model.transform(other).select("features").collect()


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(1, 6)], "a double, b double")
    rows = features.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [r.z_a for r in rows] == pytest.approx([-2**0.5, -(0.5**0.5), 0, 0.5**0.5, 2**0.5])
    assert [r.z_b for r in rows] == [0.0] * 5
    train = df.where("a < 4")
    applied = features.standardize(df, ["a"], fit_on=train).where("a = 5").first()
    assert applied.z_a == pytest.approx((5 - 2) / np.std([1, 2, 3]))


def test_one_hot(spark):
    df = spark.createDataFrame([("Switch",), ("Router",)], "t string")
    rows = features.one_hot(df, "t").orderBy("t").collect()
    assert rows[0].asDict() == {"t": "Router", "t_Switch": 0}
    assert rows[1].t_Switch == 1
    assert features.one_hot(df, "t", drop=None).columns == ["t", "t_Router", "t_Switch"]
    new = spark.createDataFrame([("Firewall",)], "t string")
    with pytest.raises(PySparkException, match="unknown t: Firewall"):
        features.one_hot(new, "t", fit_on=df).collect()


def test_feature_stages_order_and_unknown_level(spark):
    kinds = ["Router", "Switch"] * 3
    rows = [{"CPU_Usage": float(i), "Device_Type": kind} for i, kind in enumerate(kinds)]
    df = device_rows(spark, rows)
    model = features.fit_features(df)
    vectors = [r.features.toArray() for r in model.transform(df).orderBy("CPU_Usage").collect()]
    assert all(len(v) == 9 for v in vectors)
    assert [v[8] for v in vectors] == [0, 1] * 3
    cpu = np.arange(6.0)
    assert [v[0] for v in vectors] == pytest.approx((cpu - cpu.mean()) / cpu.std(ddof=1))
    unknown = device_rows(spark, [{"Device_Type": "Firewall"}]).repartition(1)
    with pytest.raises(Py4JJavaError, match="Unseen label: Firewall"):
        model.transform(unknown).collect()


def test_linear_score(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    p = df.select(features.linear_score(["a", "b"], [2, -0.5], 0.25).alias("p")).first().p
    assert p == pytest.approx(1 / (1 + math.exp(-(0.25 + 2 - 1))))
    with pytest.raises(ValueError):
        features.linear_score(["a"], [], 0)


def test_projection(spark):
    df = spark.createDataFrame([], S.TELEMETRY)
    assert features.select_features(df).columns == [*S.FEATURES, "Failed"]


def test_validation(spark):
    rows = [
        {},
        {"CPU_Usage": 100.0, "Temperature": 150.0, "Uptime": 0.0, "Log_Errors": 0},
        {"CPU_Usage": 100.01},
        {"Uptime": -0.5, "Packet_Loss": math.nan},
        {"Interface_Errors": None, "Device_Type": "Firewall"},
        {"Device_Type": None, "Uptime": math.inf},
    ]
    df = device_rows(spark, rows)
    valid, rejected = quality.validate(df)
    assert valid.count() == 2 and valid.columns == df.columns
    assert [r.reasons for r in rejected.collect()] == [
        ["out_of_range:CPU_Usage"],
        ["out_of_range:Uptime", "missing:Packet_Loss"],
        ["bad:Device_Type", "missing:Interface_Errors"],
        ["bad:Device_Type"],
    ]
    own = [("busy", F.col("CPU_Usage") < 95)]
    assert quality.validate(df, own)[1].count() == 2


def test_kept_side_matches_null_keys(spark):
    left = spark.range(50).withColumn("k", F.when(F.col("id") % 5 > 0, F.col("id") % 5))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = match(left, kept(right), ["k"]).collect()
    assert len(joined) == 50 and {r.n for r in joined} == {10}


def test_many_levels_are_refused(spark):
    df = spark.range(12).selectExpr("CAST(id AS STRING) AS level")
    assert len(features.one_hot(df, "level", max_levels=12).columns) == 12
    with pytest.raises(ValueError, match="feature_stages"):
        features.one_hot(df, "level", max_levels=11)


@pytest.mark.parametrize("levels", [["Router", "Switch"], ["Router"], ["a", "b", "c"]])
def test_linear_model_as_a_column(spark, levels):
    columns = "x double, y double, kind string, label int"
    rows = [(float(i % 17), float(i * i % 23), levels[i % len(levels)], int(i % 17 > 9)) for i in range(200)]
    df = spark.createDataFrame(rows, columns)
    stages = features.fit_features(df, ["x", "y"], ["kind"])
    fitted = LogisticRegression(labelCol="label", regParam=0.01).fit(stages.transform(df))
    model = PipelineModel([*stages.stages, fitted])
    p = features.linear_probability(model)
    both = model.transform(df).select(vector_to_array("probability")[1].alias("p"), p.alias("q"))
    assert all(abs(r.p - r.q) < 1e-12 for r in both.collect())
    df.withColumn("q", p).createOrReplaceTempView("scored_by_column")
    assert spark.sql("SELECT count(*) FROM scored_by_column WHERE q BETWEEN 0 AND 1").first()[0] == 200
    odd = spark.createDataFrame([(None, 1.0, levels[0], 0), (1.0, 1.0, "?", 0), (float("nan"), 1.0, None, 0)], columns)
    assert [r.q for r in odd.select(p.alias("q")).collect()] == [None] * 3
