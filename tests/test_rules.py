"""Scalar rules: golden scenarios, thresholds at the edge, SQL functions."""

import math

import pytest
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions import rules, text
from devicepulse.functions.sql import register_functions
from devicepulse.sources.telemetry import device_rows, scenarios

GOLDEN = {
    "cli_demo": (0.957667, 1, "cpu mem temp iface loss log"),
    "ui_default": (0.403333, 0, "none"),
    "healthy-router": (0.259611, 0, "none"),
    "healthy-switch": (0.200056, 0, "none"),
    "high-cpu": (0.677361, 1, "cpu"),
    "thermal-alert": (0.551778, 0, "temp"),
    "packet-loss": (0.705444, 1, "iface loss"),
    "critical-failure": (1.268056, 1, "cpu mem temp iface loss log uptime"),
    "api_defaults": (0.0, 0, "none"),
}


def test_golden_scenarios(spark):
    out = scenarios(spark).select(
        "scenario",
        F.round(rules.risk_score(), 6).alias("score"),
        rules.threshold_label(rules.risk_score()).alias("label"),
        F.array_join(rules.advisories(texts=None), " ").alias("advisory"),
    )
    assert {r.scenario: (r.score, r.label, r.advisory) for r in out.collect()} == GOLDEN


@pytest.mark.parametrize("key, column, limit", S.ADVISORY_RULES)
def test_advisory_fires_only_above_its_limit(spark, key, column, limit):
    quiet = S.REQUEST_DEFAULTS
    step = 1 if column in S.COUNTERS else 0.01
    exact = int(limit) if column in S.COUNTERS else limit
    rows = [quiet | {column: exact}, quiet | {column: exact + step}]
    out = device_rows(spark, rows).select(rules.advisories(texts=None).alias("a")).collect()
    assert [r.a for r in out] == [["none"], [key]]


def test_missing_readings_fire_nothing(spark):
    rows = [dict.fromkeys(S.NUMERIC_FEATURES)]
    df = device_rows(spark, rows).withColumn("CPU_Usage", F.lit(math.nan))
    row = df.select(rules.advisories(texts=None).alias("a"), rules.risk_score().alias("s")).first()
    assert row.a == ["none"]


def test_bands_at_their_edges(spark):
    values = [None, 0.0, 0.2999999, 0.30, 0.6999999, 0.70, 1.0, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    bands = [r.b for r in df.select(rules.risk_band(F.col("p")).alias("b")).collect()]
    assert bands == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH"]


def test_band_details_keep_rows_without_a_band(spark):
    df = spark.createDataFrame([(1, "LOW"), (2, None), (3, "HIGH")], "id int, risk string")
    rows = {r.id: r for r in rules.band_details(df).collect()}
    assert rows[1].risk_color == "#00e676" and rows[3].risk_color == "#ff1744"
    assert rows[2].risk_color is None and rows[2].action_text is None
    plan = rules.band_details(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_label_is_strict_and_ignores_nan(spark):
    df = spark.createDataFrame([(0.65,), (0.6500001,), (None,), (math.nan,)], "s double")
    labels = [r.x for r in df.select(rules.threshold_label(F.col("s")).alias("x")).collect()]
    assert labels == [0, 1, None, 0]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.125, 2.675, 1.0)], "a double, b double, c double")
    assert tuple(rules.round_measurements(df, ["a", "b"]).first()) == (0.13, 2.68, 1.0)
    assert rules.round_measurements(df, ["a"], half_even=True).first().a == 0.12


def test_device_ids_widen(spark):
    df = spark.createDataFrame([(1,), (99999,), (100000,), (12345678,)], "n long")
    ids = [r.x for r in df.select(text.device_id(F.col("n")).alias("x")).collect()]
    assert ids == ["DEV-00001", "DEV-99999", "DEV-100000", "DEV-12345678"]


def test_types_lenient_and_strict(spark):
    df = spark.createDataFrame([(" rOUTER ",), ("SWITCH",), ("firewall",), (None,)], "t string")
    rows = df.select(
        text.normalize_type(F.col("t")).alias("a"),
        text.normalize_type(F.col("t"), "strict").alias("b"),
    ).collect()
    assert [r.a for r in rows] == ["Router", "Switch", "Switch", "Switch"]
    assert [r.b for r in rows] == ["Router", "Switch", None, None]
    with pytest.raises(ValueError):
        text.normalize_type(F.col("t"), "guess")


def test_coercion_and_formatting(spark):
    df = spark.createDataFrame([(" 3.7 ",), ("12",), ("NaN",), ("",), (None,)], "t string")
    t = F.col("t")
    rows = df.select(
        text.to_double(t, 0.0).alias("d"),
        text.to_int(t).alias("i"),
        text.with_default(t, 5).alias("w"),
    ).collect()
    assert [r.d for r in rows] == [3.7, 12.0, 0.0, 0.0, 0.0]
    assert [r.i for r in rows] == [None, 12, None, None, None]
    assert [r.w for r in rows] == ["3.7", "12", "NaN", "5", "5"]
    shown = spark.range(1).select(
        text.percent(F.lit(0.84)).alias("p"), text.thousands(F.lit(1234567)).alias("n")
    )
    assert tuple(shown.first()) == ("84.00%", "1,234,567")


def test_sql_functions_agree_with_columns(spark):
    assert set(register_functions(spark)) == {
        "risk_score", "risk_label", "risk_band", "device_type",
    }
    scenarios(spark).createOrReplaceTempView("fleet")
    args = ", ".join(S.RISK_WEIGHTS)
    out = spark.sql(
        f"SELECT scenario, risk_score({args}) AS s, risk_label(risk_score({args})) AS l, "
        f"risk_band(risk_score({args})) AS b, device_type(Device_Type) AS t FROM fleet"
    )
    score = rules.risk_score()
    mine = scenarios(spark).select(
        "scenario",
        score.alias("s"),
        rules.threshold_label(score).alias("l"),
        rules.risk_band(score).alias("b"),
        text.normalize_type(F.col("Device_Type")).alias("t"),
    )
    assert out.collect() == mine.collect()
