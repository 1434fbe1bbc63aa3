"""Readers, writers, JSON requests and responses, saved models."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicepulse import schema as S
from devicepulse.operators.fleet import as_json, fleet_summary
from devicepulse.operators.scoring import score_by_rule, score_requests
from devicepulse.sources import models, requests, telemetry
from devicepulse.sources.errors import DatasetNotFound, ModelNotFound

HEADER = ",".join(S.TELEMETRY.fieldNames())


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [
        ("DEV-00001", "Router", 50.25, 60.0, 45.5, 100.0, 10, 0.5, 40.0, 2, 0),
        ("DEV-00002", "Switch", None, 99.99, 80.0, 1.0, 400, 9.9, 95.0, None, 1),
    ]
    df = spark.createDataFrame(rows, S.TELEMETRY)
    path = str(tmp_path / fmt)
    telemetry.write_telemetry(df, path, fmt)
    back = telemetry.read_telemetry(spark, path, fmt)
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == rows
    telemetry.write_telemetry(df, path, fmt, "overwrite")


def test_csv_missing_and_unreadable_cells(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        "DEV-00001,Router,NaN,NA,,N/A,null,0.5,40.0,2,0",
        "DEV-00002,Router,abc,60,45,100,3.7,0.5,40.0,2,0",
        "DEV-00003,Router,50",
    )
    df = telemetry.read_telemetry(spark, path, keep_errors=True)
    rows = {r.Device_ID: r for r in df.collect()}
    first = rows["DEV-00001"]
    assert [first[c] for c in S.NUMERIC_FEATURES[:5]] == [None] * 5
    assert first.read_errors == [] and first.Packet_Loss == 0.5
    second = rows["DEV-00002"]
    assert second.CPU_Usage is None and second.Memory_Usage == 60.0
    assert second.read_errors == ["unreadable:CPU_Usage", "unreadable:Interface_Errors"]
    assert rows["DEV-00003"].read_errors == ["malformed_row"]
    assert "read_errors" not in telemetry.read_telemetry(spark, path).columns


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names = [*reversed(S.TELEMETRY.fieldNames()), "Site"]
    path = tmp_path / "moved.csv"
    path.write_text(",".join(names) + "\n0,2,40.0,0.5,10,100,45.5,60,50.25,Router,DEV-00001,x\n")
    row = telemetry.read_telemetry(spark, str(path), keep_errors=True).first()
    assert (row.Device_ID, row.CPU_Usage, row.Failed) == ("DEV-00001", 50.25, 0)
    assert row.read_errors == []
    path = tmp_path / "short.csv"
    path.write_text("Device_ID,CPU_Usage\na,1\n")
    with pytest.raises(ValueError, match="no column Device_Type"):
        telemetry.read_telemetry(spark, str(path))


def test_nan_in_parquet_becomes_null(spark, tmp_path):
    row = ("DEV-00001", "Router", math.nan, 60.0, 45.5, 100.0, 10, 0.5, 40.0, 2, 0)
    path = str(tmp_path / "p")
    telemetry.write_telemetry(spark.createDataFrame([row], S.TELEMETRY), path)
    assert telemetry.read_telemetry(spark, path, "parquet").first().CPU_Usage is None


def test_missing_dataset_and_model(spark, tmp_path):
    with pytest.raises(DatasetNotFound):
        telemetry.read_telemetry(spark, str(tmp_path / "nope.csv"))
    with pytest.raises(ModelNotFound):
        models.load_model(str(tmp_path / "nope"))
    with pytest.raises(ValueError):
        telemetry.read_telemetry(spark, "x", "xml")
    assert models.active_model_name(None) == "None (Model not trained)"


CASES = {
    '{"CPU_Usage": 1.5, "Interface_Errors": 3.7}': (1.5, 3, []),
    '{"CPU_Usage": " 1.5 ", "Interface_Errors": "3"}': (1.5, 3, []),
    '{"CPU_Usage": true}': (1.0, 0, []),
    '{"CPU_Usage": 1, "CPU_Usage": 2}': (2.0, 0, []),
    '{"other": 1}': (0.0, 0, []),
    '{"Interface_Errors": "3.7"}': (0.0, None, ["not_a_number:Interface_Errors"]),
    '{"CPU_Usage": null}': (None, 0, ["not_a_number:CPU_Usage"]),
    '{"CPU_Usage": "abc", "Log_Errors": []}': (
        None, 0, ["not_a_number:CPU_Usage", "not_a_number:Log_Errors"],
    ),
    '{"CPU_Usage": "NaN"}': (None, 0, ["not_a_number:CPU_Usage"]),
    "{}": (None, None, ["empty_request"]),
    '{"CPU_Usage": 1': (None, None, ["malformed_json"]),
    "[]": (None, None, ["malformed_json"]),
    '[{"CPU_Usage": 1}]': (None, None, ["malformed_json"]),
    "5": (None, None, ["malformed_json"]),
    "": (None, None, ["malformed_json"]),
    None: (None, None, ["malformed_json"]),
}


def test_decode_requests(spark):
    df = spark.createDataFrame([(text,) for text in CASES], "request string")
    rows = {r.request: r for r in requests.decode_requests(df).collect()}
    found = {t: (r.CPU_Usage, r.Interface_Errors, r.reasons) for t, r in rows.items()}
    assert found == CASES
    assert rows['{"other": 1}'].Device_Type == "Router"
    types = ['" rOUTER "', '"firewall"', "null", "5"]
    df = spark.createDataFrame([(f'{{"Device_Type": {t}}}',) for t in types], "request string")
    found = [r.Device_Type for r in requests.decode_requests(df).collect()]
    assert found == ["Router", "Switch", "Switch", "Switch"]


def test_responses(spark):
    row = score_by_rule(telemetry.scenarios(spark).where("scenario = 'cli_demo'"))
    response = json.loads(requests.encode_responses(row).first().response)
    assert list(response) == [
        "success", "prediction", "probability", "risk", "risk_color", "status_text", "advisory",
        "model_used",
    ]
    assert response["success"] is True and response["risk"] == "HIGH"
    assert response["prediction"] == 1 and len(response["advisory"]) == 6


def test_requests_without_a_model_get_an_error(spark):
    df = spark.createDataFrame([(1, '{"CPU_Usage": 5}'), (2, "{}")], "id int, request string")
    answers = {r.id: json.loads(r.response) for r in score_requests(df, None).collect()}
    assert answers == {
        1: {"error": "no model loaded"},
        2: {"error": "no model loaded, empty_request"},
    }


def test_summary_as_json(spark):
    empty = spark.createDataFrame([], S.TELEMETRY)
    summary = json.loads(as_json(fleet_summary(empty)).first().response)
    assert len(summary) == 12
    assert summary["total_devices"] == 0 and summary["failed_count"] == 0
    assert summary["health_rate"] is None and summary["avg_cpu"] is None
    some = empty.union(
        spark.createDataFrame([("a", "Router", *[1.0] * 4, 1, 1.0, 1.0, 1, 1)], S.TELEMETRY)
    )
    assert fleet_summary(some).select(F.col("health_rate")).first()[0] == 0.0


def test_typed_numbers_are_read_as_they_are(spark, tmp_path):
    row = ("d", "Router", 1.5, 2.0, 3.0, 4.0, 5_000_000_000, 6.0, 7.0, 8, 1)
    kinds = T.StructType(list(S.TELEMETRY))
    df = spark.createDataFrame([row], kinds).withColumn("Log_Errors", F.col("Log_Errors").cast("int"))
    df.write.parquet(str(tmp_path / "typed"))
    found = telemetry.read_telemetry(spark, str(tmp_path / "typed"), "parquet", keep_errors=True)
    assert tuple(found.first()) == (*row, [])
    assert found.drop("read_errors").schema == S.TELEMETRY
    wide = found.where("Interface_Errors > 5")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Interface_Errors,5)" in plan


def test_what_fits_without_text():
    fits = telemetry._fits
    assert fits(T.IntegerType(), T.LongType()) and fits(T.IntegerType(), T.DoubleType())
    assert fits(T.DoubleType(), T.DoubleType()) and fits(T.LongType(), T.LongType())
    assert not fits(T.LongType(), T.IntegerType()) and not fits(T.LongType(), T.DoubleType())
    assert not fits(T.FloatType(), T.DoubleType())
    assert not fits(T.StringType(), T.StringType()) and not fits(T.DoubleType(), T.LongType())
