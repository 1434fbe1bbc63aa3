"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions import rules, text
from devicepulse.functions.sql import register_functions
from devicepulse.operators import (
    evaluation,
    features,
    fleet,
    profile,
    quality,
    scoring,
    split,
    training,
)
from devicepulse.plans import increments
from devicepulse.plans.readings import DIRTY, REQUEST, readings, readings_of, table, table_stream
from devicepulse.session import ensure_checkpoint_dir, match, new_folder, reread
from devicepulse.sources import requests
from devicepulse.sources.models import load_model, save_model
from devicepulse.sources.telemetry import read_telemetry, write_telemetry
from devicepulse.streaming import live, quarantine, quiet
from devicepulse.streaming.debounce import debounce as keep_last

# Thresholds of the risk score that act as three models, and their names.
RULE_MODELS = {"logistic rule": 0.60, "random rule": 0.65, "boosted rule": 0.70}
LINEAR = dict(zip(S.NUMERIC_FEATURES, [2.5, 1.75, 1.5, 0.0, 1.25, 1.0, 0.75, 0.5]))
LINEAR_INTERCEPT = -3.0
# Labelled rows that the registered training queries fit on at most; None is all of them.
MAX_FIT_ROWS = None
# What every candidate reaches on the hold-out: a value that none falls below on many rows,
# less an allowance of so many times the spread of a share over its positives.
F1_FLOOR, AUC_FLOOR = (0.66, 0.5), (0.945, 0.2)
LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_KEY = ["l_orderkey", "l_linenumber"]
# Weights and scales of a risk score of order lines, and what makes a long document. One
# scale is prime, so that no score lies half way between two of six decimals.
LINEITEM_WEIGHTS = {
    "l_quantity": (0.5, 50.0), "l_extendedprice": (0.25, 104_729.0), "l_discount": (0.25, 0.1),
}
LONG_DOCUMENT = 500


def r6(c: Column | str) -> Column:
    """Six decimals and no negative zero, so that engines can be compared."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _profiled(spark, sf) -> DataFrame:
    """The telemetry table as a user would have it: keys, readings and label."""
    return readings(spark, sf).select(S.TELEMETRY.fieldNames())


def _banded(spark, sf) -> DataFrame:
    p = rules.as_probability(F.col("Risk_Score"))
    return readings(spark, sf).select("Reading_ID", rules.risk_band(p).alias("risk"))


def _predictions(spark, sf) -> DataFrame:
    """One row per reading and rule model."""
    score = F.col("Risk_Score")
    models = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"), rules.threshold_label(score, t).alias("prediction")
            )
            for name, t in RULE_MODELS.items()
        ]
    )
    rows = readings(spark, sf).select(
        F.inline(models), F.col("Failed").alias("label"), rules.as_probability(score).alias("p")
    )
    return rows.withColumnRenamed("p", "probability")


def _one_model(spark, sf) -> DataFrame:
    score = F.col("Risk_Score")
    return readings(spark, sf).select(
        F.col("Failed").alias("label"),
        rules.threshold_label(score).alias("prediction"),
        rules.as_probability(score).alias("probability"),
    )


def fleet_summary(spark, sf):
    return fleet.fleet_summary(readings(spark, sf))


def fleet_by_type(spark, sf):
    return fleet.fleet_summary(readings(spark, sf), ["Device_Type"])


def fleet_by_device(spark, sf):
    return fleet.fleet_summary(readings(spark, sf), ["Device_ID"])


def risk_score(spark, sf):
    return readings(spark, sf).select("Reading_ID", r6(rules.risk_score()).alias("score"))


def threshold_label(spark, sf):
    label = rules.threshold_label(rules.risk_score())
    return readings(spark, sf).select("Reading_ID", label.alias("label"))


def feature_projection(spark, sf):
    return features.select_features(readings(spark, sf))


def rounded_measurements(spark, sf):
    thirds = readings(spark, sf).withColumns({c: F.col(c) / 3 for c in S.MEASUREMENTS})
    return rules.round_measurements(thirds).select("Reading_ID", *S.MEASUREMENTS)


def risk_band(spark, sf):
    return _banded(spark, sf)


def band_details(spark, sf):
    return rules.band_details(_banded(spark, sf))


def advisories(spark, sf):
    keys = rules.advisories(texts=None)
    return readings(spark, sf).select("Reading_ID", F.array_join(keys, "|").alias("advisory"))


def advisory_counts(spark, sf):
    return fleet.advisory_counts(readings(spark, sf))


def validation_report(spark, sf):
    dirty = readings(spark, sf).selectExpr("Reading_ID", *_columns(DIRTY))
    checked = quality.add_reasons(dirty)
    return checked.select(
        "Reading_ID",
        (F.size("reasons") == 0).cast("int").alias("valid"),
        F.array_join("reasons", "|").alias("reasons"),
    )


def _columns(sql: str) -> list[str]:
    """A list of SQL columns, one per line."""
    return [line.strip().rstrip(",") for line in sql.strip().splitlines()]


def decode_requests(spark, sf):
    rows = readings(spark, sf).selectExpr("Reading_ID", f"{REQUEST} AS request")
    decoded = requests.decode_requests(rows)
    return decoded.select(
        "Reading_ID", *S.FEATURES, F.array_join("reasons", "|").alias("reasons")
    )


def normalize_type(spark, sf):
    given = F.expr(
        "CASE Reading_ID % 6 WHEN 0 THEN ' rOUTER ' WHEN 1 THEN 'SWITCH' WHEN 2 THEN 'firewall' "
        "WHEN 3 THEN NULL ELSE Device_Type END"
    )
    return readings(spark, sf).select(
        "Reading_ID",
        text.normalize_type(given).alias("lenient"),
        text.normalize_type(given, "strict").alias("strict"),
    )


def apply_defaults(spark, sf):
    def typed(c):
        return F.expr(
            f"CASE Reading_ID % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL "
            f"ELSE concat(' ', CAST({c} AS STRING)) END"
        )

    def field(c):
        return text.with_default(typed(c), S.FORM_DEFAULTS[c])

    return readings(spark, sf).select(
        "Reading_ID",
        field("Device_Type").alias("Device_Type"),
        *[
            (text.to_int if c in S.COUNTERS else text.to_double)(field(c)).alias(c)
            for c in S.NUMERIC_FEATURES
        ],
    )


def device_ids(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        text.device_id(F.col("user_id") + 1).alias("device"),
        text.device_id(F.col("event_id") * 1000 + 1).alias("wide"),
    )


def head(spark, sf):
    return profile.head(readings(spark, sf), "Reading_ID")


def riskiest_devices(spark, sf):
    rows = _rounded(readings(spark, sf), "Risk_Score")
    top = fleet.riskiest(rows, "Risk_Score", "Reading_ID", 20)
    return top.select("Reading_ID", "Device_ID", "Risk_Score")


def shape(spark, sf):
    return profile.shape(_profiled(spark, sf))


def missing_counts(spark, sf):
    return profile.missing_counts(readings(spark, sf).selectExpr("Reading_ID", *_columns(DIRTY)))


def column_info(spark, sf):
    return profile.column_info(readings(spark, sf).selectExpr("Reading_ID", *_columns(DIRTY)))


def _described(df, cols):
    return _rounded(profile.describe(df, cols), "mean", "std", *profile.QUARTILES)


def describe(spark, sf):
    df = _profiled(spark, sf)
    return _described(df, profile.numeric_columns(df))


def failure_distribution(spark, sf):
    return profile.value_counts(readings(spark, sf), "Failed")


def type_breakdown(spark, sf):
    return profile.value_counts(readings(spark, sf), "Device_Type")


def correlation_matrix(spark, sf):
    df = _profiled(spark, sf)
    return _rounded(profile.correlation_matrix(df, profile.numeric_columns(df)), "corr")


def _boxes(df, group, cols):
    stats = profile.box_stats(df, group, cols)
    return _rounded(stats, *profile.QUARTILES, "low_whisker", "high_whisker")


def box_stats_cpu(spark, sf):
    return _boxes(readings(spark, sf), "Failed", ["CPU_Usage"])


def box_stats_memory(spark, sf):
    return _boxes(readings(spark, sf), "Failed", ["Memory_Usage"])


def box_stats_temperature(spark, sf):
    return _boxes(readings(spark, sf), "Failed", ["Temperature"])


def box_outliers(spark, sf):
    out = profile.box_outliers(readings(spark, sf), "Failed", "Interface_Errors")
    out = out.select(
        "Reading_ID", "Failed", "Interface_Errors", "low_fence", "high_fence"
    )
    return _rounded(out, "low_fence", "high_fence")


def confusion(spark, sf):
    return evaluation.confusion(_predictions(spark, sf), "label", "prediction", ["model"])


def binary_metrics(spark, sf):
    out = evaluation.binary_metrics(_predictions(spark, sf), "label", "prediction", ["model"])
    return _rounded(out, *evaluation.METRICS)


def roc_auc(spark, sf):
    return _rounded(evaluation.roc_auc(_one_model(spark, sf), "label", "probability"), "roc_auc")


def classification_report(spark, sf):
    out = evaluation.classification_report(_one_model(spark, sf), "label", "prediction")
    return _rounded(out, "precision", "recall", "f1")


def classification_report_by_model(spark, sf):
    rows = _predictions(spark, sf)
    out = evaluation.classification_report(rows, "label", "prediction", ["model"])
    return _rounded(out, "precision", "recall", "f1")


def _board(spark, sf):
    rows = _predictions(spark, sf)
    board = evaluation.leaderboard(rows, "model", "label", "prediction", "probability")
    return _rounded(board, *evaluation.METRICS, "roc_auc")


def leaderboard(spark, sf):
    return _board(spark, sf)


def leaderboard_status(spark, sf):
    board = evaluation.mark_active(binary_metrics(spark, sf), "Random Forest Classifier")
    return board.select("model", "f1", "status")


def best_model(spark, sf):
    return evaluation.best_model(_board(spark, sf), order=list(RULE_MODELS))


def stratified_split(spark, sf):
    flagged = split.mark_test(readings(spark, sf), "Reading_ID", "Failed")
    side = F.when(F.col(split.TEST), "test").otherwise("train")
    return flagged.select("Reading_ID", "Failed", side.alias("side"))


def split_counts(spark, sf):
    return split.split_counts(readings(spark, sf), "Reading_ID", "Failed")


def split_counts_labels(spark, sf):
    return split.split_counts(table(spark, sf, "labels"), "doc_id", "quality")


def class_weights(spark, sf):
    return _rounded(split.class_weights(readings(spark, sf), "Failed"), "weight")


def class_weights_labels(spark, sf):
    return _rounded(split.class_weights(table(spark, sf, "labels"), "toxic"), "weight")


def _standardized(spark, sf):
    return features.standardize(readings(spark, sf), S.NUMERIC_FEATURES)


def standardized(spark, sf):
    z = [f"z_{c}" for c in S.NUMERIC_FEATURES]
    return _rounded(_standardized(spark, sf), *z).select("Reading_ID", *z)


def one_hot(spark, sf):
    rows = readings(spark, sf).select("Reading_ID", "Device_Type")
    return features.one_hot(rows, "Device_Type")


def linear_score(spark, sf):
    p = features.linear_score([f"z_{c}" for c in LINEAR], list(LINEAR.values()), LINEAR_INTERCEPT)
    return _standardized(spark, sf).select("Reading_ID", r6(p).alias("probability"))


def rule_scoring(spark, sf):
    out = scoring.score_by_rule(readings(spark, sf))
    return out.select(
        "Reading_ID",
        "Device_ID",
        "prediction",
        r6("probability").alias("probability"),
        "risk",
        "risk_color",
        "status_text",
        "action_text",
        F.array_join("advisory", "|").alias("advisory"),
        "model_used",
    )


def encode_responses(spark, sf):
    """Responses as JSON text, read back so that their fields can be compared."""
    encoded = requests.encode_responses(scoring.score_by_rule(readings(spark, sf)))
    fields = (
        "success boolean, prediction int, probability double, risk string, risk_color string, "
        "status_text string, advisory array<string>, model_used string"
    )
    parsed = encoded.select("Reading_ID", F.from_json("response", fields).alias("r"))
    out = parsed.select("Reading_ID", "r.*")
    out = out.withColumn("advisory", F.array_join("advisory", "|"))
    return _rounded(out, "probability")


def fleet_summary_json(spark, sf):
    """The fleet summary as JSON text, read back so that its fields can be compared."""
    summary = fleet.fleet_summary(readings(spark, sf))
    parsed = fleet.as_json(summary).select(F.from_json("response", summary.schema).alias("r"))
    return parsed.select("r.*")


def sql_functions(spark, sf):
    """The rules as functions in SQL text."""
    register_functions(spark)
    readings(spark, sf).createOrReplaceTempView("devicepulse_readings")
    score = f"risk_score({', '.join(S.RISK_WEIGHTS)})"
    out = spark.sql(
        f"SELECT Reading_ID, {score} AS score, risk_label({score}) AS label, "
        f"risk_band({score}) AS band, device_type(Device_Type) AS kind FROM devicepulse_readings"
    )
    return _rounded(out, "score")


def debounce(spark, sf):
    events = table(spark, sf, "events")
    last = keep_last(events, "user_id", "ts", dt.timedelta(minutes=30), tiebreak="event_id")
    return last.select("event_id", "user_id", "ts")


def feature_vector(spark, sf):
    """The vector of the fitted feature stages, as one column per entry."""
    rows = readings(spark, sf)
    vectors = features.fit_features(rows).transform(rows)
    entries = vector_to_array("features")
    names = [*[f"z_{c}" for c in S.NUMERIC_FEATURES], "is_switch"]
    return vectors.select("Reading_ID", *[r6(entries[i]).alias(c) for i, c in enumerate(names)])


def telemetry_files(spark, sf):
    """Readings written as CSV text, read again with their types, and profiled."""
    folder = new_folder(spark, "telemetry")
    dirty = readings(spark, sf).selectExpr("Device_ID", *_columns(DIRTY), "Failed", "Reading_ID")
    write_telemetry(dirty, f"{folder}/csv", "csv")
    return profile.missing_counts(read_telemetry(spark, f"{folder}/csv", "csv"))


def scoring_stream(spark, sf):
    """Requests replayed as a stream and scored by rule into a file sink; the responses
    are read back so that their fields can be compared."""
    rows = readings_of(table_stream(spark, sf, "events"))
    stream = rows.selectExpr("Reading_ID", f"{REQUEST} AS request")
    scored = live.score_stream(stream, None, scorer=scoring.score_by_rule)
    out = live.catch_up(scored.select("Reading_ID", "response"), new_folder(spark, "scored"))
    fields = (
        "success boolean, prediction int, probability double, risk string, risk_color string, "
        "status_text string, advisory array<string>, model_used string, error string"
    )
    out = out.select("Reading_ID", F.from_json("response", fields).alias("r"))
    out = out.select("Reading_ID", "r.*").withColumn("advisory", F.array_join("advisory", "|"))
    return _rounded(out, "probability")


def quarantine_stream(spark, sf):
    """Faulty readings replayed as a stream and sorted into accepted and rejected rows."""
    folder = new_folder(spark, "quarantine")
    dirty = readings_of(table_stream(spark, sf, "events")).selectExpr("Reading_ID", *_columns(DIRTY))
    quarantine.sort_out(dirty, folder, once=True).awaitTermination()
    sides = [
        quarantine.sorted_rows(spark, folder, side).select(
            "Reading_ID", F.lit(side).alias("side"), F.array_join("reasons", "|").alias("reasons")
        )
        for side in quarantine.SIDES
    ]
    return sides[0].unionByName(sides[1])


def quiet_stream(spark, sf):
    """Events replayed as a stream: the last of each burst, let go by a later event or by
    the timer of its key."""
    folder = new_folder(spark, "quiet")
    stream = table_stream(spark, sf, "events").select("event_id", "user_id", "ts")
    gap, idle = dt.timedelta(minutes=30), dt.timedelta(milliseconds=500)
    last = quiet.settled(stream, "user_id", "ts", gap, idle, tiebreak="event_id")
    query = live.start(last, f"{folder}/checkpoint", "parquet", path=f"{folder}/rows")
    quiet.until_settled(query)
    return spark.read.schema(last.schema).parquet(f"{folder}/rows")


def summary_stream(spark, sf):
    """The live summary by device type after the last batch of the replayed readings."""
    folder = new_folder(spark, "summary")
    rows = readings_of(table_stream(spark, sf, "events"))
    summary = live.fleet_summary_stream(rows, ["Device_Type"])

    def replace(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    writer = summary.writeStream.outputMode("complete").foreachBatch(replace)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(summary.schema).parquet(f"{folder}/rows")


def incremental_summary(spark, sf):
    """The summary by device type of readings that arrive in three shares, each scanned once."""
    folder = new_folder(spark, "increments")
    columns = [*S.FEATURES, S.LABEL, "Reading_ID"]
    for share in range(3):
        arrived = readings(spark, sf).select(columns).where(F.col("Reading_ID") % 3 == share)
        arrived.write.mode("append").parquet(f"{folder}/readings")
        out = increments.refresh(spark, f"{folder}/readings", f"{folder}/sums", ["Device_Type"])
    return out


def percent_text(spark, sf):
    shares = readings(spark, sf).select("Reading_ID", (F.col("Interface_Errors") / 700).alias("p"))
    return shares.select("Reading_ID", text.percent(F.col("p")).alias("percent"))


def thousands_text(spark, sf):
    events = table(spark, sf, "events")
    wide = F.col("event_id") * 12_345 - 1_000_000
    return events.select("event_id", text.thousands(wide).alias("thousands"))


def request_errors(spark, sf):
    """How many requests are answered with each error."""
    rows = readings(spark, sf).selectExpr(f"{REQUEST} AS request")
    answers = scoring.score_requests(rows, None, scorer=scoring.score_by_rule)
    error = F.get_json_object("response", "$.error").alias("error")
    return profile.value_counts(answers.select(error), "error")


def describe_lineitem(spark, sf):
    return _described(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)


def missing_counts_lineitem(spark, sf):
    return profile.missing_counts(table(spark, sf, "lineitem"))


def value_counts_events(spark, sf):
    return profile.value_counts(table(spark, sf, "events"), "event_type")


def correlation_lineitem(spark, sf):
    pairs = profile.correlation_matrix(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)
    return _rounded(pairs, "corr")


def box_stats_lineitem(spark, sf):
    return _boxes(table(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice"])


def box_stats_events(spark, sf):
    return _boxes(table(spark, sf, "events"), "event_type", ["value"])


def risk_score_lineitem(spark, sf):
    score = rules.risk_score(LINEITEM_WEIGHTS)
    return table(spark, sf, "lineitem").select(
        *LINEITEM_KEY,
        r6(score).alias("score"),
        rules.threshold_label(score, 0.5).alias("label"),
        rules.risk_band(rules.as_probability(score)).alias("band"),
    )


def standardized_lineitem(spark, sf):
    z = [f"z_{c}" for c in LINEITEM_NUMBERS]
    rows = features.standardize(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)
    return _rounded(rows, *z).select(*LINEITEM_KEY, *z)


def one_hot_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINEITEM_KEY, "l_returnflag")
    return features.one_hot(rows, "l_returnflag")


def _long_documents(spark, sf) -> DataFrame:
    """Labelled documents, with their length as the score of quality."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return rows.withColumn("long", (F.col("n_chars") > LONG_DOCUMENT).cast("int"))


def binary_metrics_documents(spark, sf):
    out = evaluation.binary_metrics(_long_documents(spark, sf), "quality", "long", ["lang"])
    return _rounded(out, *evaluation.METRICS)


def roc_auc_documents(spark, sf):
    out = evaluation.roc_auc(_long_documents(spark, sf), "quality", "n_chars", ["lang"])
    return _rounded(out, "roc_auc")


def trained(spark, sf):
    """(hold-out rows, models, leaderboard) of the full candidates over the telemetry.

    They are fitted on every row that is not held out, once per table and application, and
    saved in the shared folder, where later queries load them. The leaderboard is written
    last and tells that all is there. Split, preprocessing and weights read the readings
    many times: they are derived once.
    """
    events = table(spark, sf, "events").select("event_id", "user_id")
    content = events.agg(F.count("*"), F.bit_xor(F.xxhash64("*"))).first()
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    folder = f"{shared}/models-{content[0]}-{content[1]}-{MAX_FIT_ROWS}"
    try:
        board = spark.read.parquet(f"{folder}/board")
    except AnalysisException:
        rows = reread(readings(spark, sf, spread=True))
        train, test = split.stratified_split(rows, "Reading_ID", "Failed")
        test.write.mode("overwrite").parquet(f"{folder}/holdout")
        models, board = training.train_candidates(train, test, max_fit_rows=MAX_FIT_ROWS)
        for name, model in models.items():
            save_model(model, f"{folder}/{name.replace(' ', '-')}")
        board.write.mode("overwrite").parquet(f"{folder}/board")
        board = spark.read.parquet(f"{folder}/board")
    names = training.candidates(1)
    models = {name: load_model(f"{folder}/{name.replace(' ', '-')}") for name in names}
    return spark.read.parquet(f"{folder}/holdout"), models, board


def train_compare(spark, sf):
    """Per candidate the size of its hold-out and whether it reaches the floors."""
    test, models, board = trained(spark, sf)
    # A task gets all models of its stage: each is counted in one of its own.
    scored = [
        scoring.score_fleet(test, model).select(F.lit(name).alias("model"), "Failed", "prediction")
        for name, model in models.items()
    ]
    counted = [evaluation.confusion(one, "Failed", "prediction", ["model"]) for one in scored]
    cells = functools.reduce(DataFrame.unionByName, counted)
    total = functools.reduce(operator.add, [F.col(c) for c in evaluation.CELLS])
    positives = F.col("tp") + F.col("fn")

    def floor(value, allowance):
        return F.lit(value) - F.lit(allowance) / F.sqrt(positives)

    reached = (F.col("f1") >= floor(*F1_FLOOR)) & (F.col("roc_auc") >= floor(*AUC_FLOOR))
    return match(cells, board, ["model"]).select(
        "model",
        total.alias("n"),
        positives.alias("positives"),
        reached.alias("reaches_floors"),
    )


def scored_fleet(spark, sf) -> DataFrame:
    """All valid readings, scored with the candidate that is best on the hold-out."""
    _, models, board = trained(spark, sf)
    _, model = training.choose_model(models, board)
    valid, _ = quality.validate(readings(spark, sf, spread=True))
    return scoring.score_fleet(valid, model)


def fleet_scoring(spark, sf):
    """Per reading its advisories, and whether band and class agree with the probability."""
    p = F.col("probability")
    band = F.when(p >= S.HIGH_FROM, "HIGH").when(p >= S.LOW_BELOW, "MEDIUM").otherwise("LOW")
    return scored_fleet(spark, sf).select(
        "Reading_ID",
        F.array_join("advisory", "|").alias("advisory"),
        (F.col("risk") == band).alias("band_agrees"),
        ((p > 0.5) == (F.col("prediction") == 1)).alias("class_agrees"),
    )


REGISTERED = [
    fleet_summary, fleet_by_type, fleet_by_device, risk_score, threshold_label,
    feature_projection, rounded_measurements, risk_band, band_details, advisories,
    advisory_counts, validation_report, decode_requests, normalize_type, apply_defaults,
    device_ids, head, riskiest_devices, shape, missing_counts, column_info, describe,
    failure_distribution, type_breakdown, correlation_matrix, box_stats_cpu, box_stats_memory,
    box_stats_temperature, box_outliers, confusion, binary_metrics, roc_auc,
    classification_report, classification_report_by_model, leaderboard, leaderboard_status,
    best_model, stratified_split,
    split_counts, split_counts_labels, class_weights, class_weights_labels, standardized,
    one_hot, linear_score, rule_scoring, encode_responses, fleet_summary_json, sql_functions,
    debounce, describe_lineitem, missing_counts_lineitem, value_counts_events,
    correlation_lineitem, box_stats_lineitem, box_stats_events, risk_score_lineitem,
    standardized_lineitem, one_hot_lineitem, binary_metrics_documents, roc_auc_documents,
    train_compare, fleet_scoring, scoring_stream, quarantine_stream, quiet_stream,
    summary_stream, incremental_summary, feature_vector, telemetry_files, percent_text, thousands_text, request_errors,
]
QUERIES = {f.__name__: f for f in REGISTERED}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest readings of the fleet with band, details and advisories."""
    top = fleet.riskiest(readings(spark, sf_dir), "Risk_Score", "Reading_ID", 20)
    return scoring.score_by_rule(top)
