"""Values that other tools write, wide counters, and missing values and predictions."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.operators import evaluation, features, fleet, profile
from devicepulse.sources.telemetry import read_telemetry

ROW = dict(zip(S.FEATURES, S.SCENARIO_ROWS[0][1:]))


def table(**changes):
    rows = [{"Device_ID": f"d{i}", **ROW, "Failed": i % 2} for i in range(3)]
    frame = pd.DataFrame(rows)[S.TELEMETRY.fieldNames()]
    for column, values in changes.items():
        frame[column] = values
    return frame


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_counters_with_a_gap_and_over_32_bits(spark, tmp_path, fmt):
    frame = table(Interface_Errors=[3_000_000_000, None, 7], Failed=[1.0, None, 0.0])
    path = str(tmp_path / f"t.{fmt}")
    frame.to_csv(path, index=False) if fmt == "csv" else frame.to_parquet(path)
    rows = read_telemetry(spark, path, fmt, keep_errors=True).orderBy("Device_ID").collect()
    assert [r.Interface_Errors for r in rows] == [3_000_000_000, None, 7]
    assert [r.Failed for r in rows] == [1, None, 0]
    assert all(r.read_errors == [] for r in rows)


def test_parts_of_a_count_are_unreadable(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    table(Log_Errors=[3.7, 4.0, 5.0]).to_csv(path, index=False)
    rows = read_telemetry(spark, path, keep_errors=True).orderBy("Device_ID").collect()
    assert [r.Log_Errors for r in rows] == [None, 4, 5]
    assert rows[0].read_errors == ["unreadable:Log_Errors"]


def test_broken_json_is_named(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"Device_ID": "a", "CPU_Usage": "hot", "Log_Errors": 5}\n{"Device_ID": \n')
    rows = read_telemetry(spark, str(path), "json", keep_errors=True).collect()
    found = {r.Device_ID: (r.Log_Errors, r.read_errors) for r in rows}
    assert found == {"a": (5, ["unreadable:CPU_Usage"]), None: (None, ["malformed_row"])}


def test_nan_is_missing(spark):
    rows = [(*S.SCENARIO_ROWS[i][1:], float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, [*S.FEATURES, "score"]).withColumn("Failed", F.lit(0))
    nan = F.when(F.col("score") == 1, F.lit(math.nan))
    df = df.withColumn("CPU_Usage", F.coalesce(nan, "CPU_Usage"))
    df = df.withColumn("score", F.coalesce(nan, "score"))
    expected = df.toPandas()["CPU_Usage"].mean()
    assert fleet.fleet_summary(df).first().avg_cpu == pytest.approx(expected, abs=0.005)
    assert [r.score for r in fleet.riskiest(df, "score", "score", 5).collect()] == [2.0, 0.0]
    assert profile.value_counts(df, "score").count() == 2


def test_missing_predictions_are_wrong_in_every_metric(spark):
    rows = [(1, 1.0), (1, None), (0, 0.0), (0, math.nan), (None, 1.0)]
    df = spark.createDataFrame(rows, "y int, z double")
    cells = evaluation.confusion(df, "y", "z").first()
    assert (cells.tp, cells.fp, cells.fn, cells.tn) == (1, 1, 1, 1)
    metrics = evaluation.binary_metrics(df, "y", "z").first()
    report = {r["class"]: r for r in evaluation.classification_report(df, "y", "z").collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].f1 == metrics.accuracy == 0.5
    assert (report["1"].precision, report["1"].recall) == (metrics.precision, metrics.recall)


def test_many_levels_and_a_single_one(spark):
    wide = spark.range(1_002).select(F.format_string("l%04d", "id").alias("c"))
    assert len(features.one_hot(wide, "c").columns) == 1_002
    one = spark.createDataFrame([("a",)], "c string")
    other = spark.createDataFrame([("b",)], "c string")
    with pytest.raises(Exception, match="unknown c: b"):
        features.one_hot(other, "c", fit_on=one).collect()
