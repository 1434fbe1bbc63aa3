"""Scoring fleets and requests, with a fitted model or with the risk formula."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions.rules import (
    advisories,
    as_probability,
    band_details,
    risk_band,
    risk_score,
    threshold_label,
)
from devicepulse.operators.training import failure_probability
from devicepulse.sources.models import active_model_name
from devicepulse.sources.requests import decode_requests, encode_responses

OUTPUTS = ["prediction", "probability"]


def _explain(df: DataFrame, model_used: str) -> DataFrame:
    """Add band, its details, advisories and the model name to scored rows."""
    banded = band_details(df.withColumn("risk", risk_band(F.col("probability"))))
    return banded.withColumns({"advisory": advisories(), "model_used": F.lit(model_used)})


def score_fleet(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add class, failure probability, band, details, advisories and model name.

    Works on a stream as well. Rows with missing readings or an unknown device type
    fail the job; set them aside with ``validate`` first.
    """
    scored = failure_probability(model.transform(df)).select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"), "probability"
    )
    return _explain(scored, active_model_name(model))


def score_by_rule(df: DataFrame, score: Column | None = None) -> DataFrame:
    """The same columns from the risk formula (or another score) instead of a model."""
    value = risk_score() if score is None else score
    scored = df.withColumns(
        {"prediction": threshold_label(value), "probability": as_probability(value)}
    )
    return _explain(scored, "Risk Score")


def score_requests(
    df: DataFrame,
    model: PipelineModel | None,
    col: str = "request",
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``response`` to JSON requests, keeping the other columns.

    Each request is either scored in full or answered with an error; without a
    model all get an error. A ``scorer``, such as ``score_by_rule``, may stand in for
    the model. Works on a stream as well. Unusable rows pass through
    the model with default readings, so that batch and stream need no second read
    of their input, and their scores are then dropped.
    """
    decoded = decode_requests(df, col)
    if model is None and scorer is None:
        reasons = F.array_insert("reasons", 1, F.lit("no model loaded"))
        failed = decoded.withColumn("reasons", reasons)
        answer = F.to_json(F.struct(F.array_join("reasons", ", ").alias("error")))
        return failed.withColumn("response", answer).select(*df.columns, "response")
    fill = {c: F.coalesce(F.col(c), F.lit(S.REQUEST_DEFAULTS[c])) for c in S.FEATURES}
    filled = decoded.withColumns(fill)
    scored = scorer(filled) if scorer else score_fleet(filled, model)
    return encode_responses(scored, "reasons").select(*df.columns, "response")
