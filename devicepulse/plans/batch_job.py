"""The whole batch job: read, validate, profile, train, choose, save, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from devicepulse import schema as S
from devicepulse.operators import evaluation, fleet, profile, quality, scoring, split, training
from devicepulse.session import reread
from devicepulse.sources import models, telemetry


def profile_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Every profile of a telemetry table, by name."""
    numbers = profile.numeric_columns(df)
    return {
        "shape": profile.shape(df),
        "column_info": profile.column_info(df),
        "missing_counts": profile.missing_counts(df),
        "summary": profile.describe(df, numbers),
        "failure_distribution": profile.value_counts(df, S.LABEL),
        "correlation": profile.correlation_matrix(df, numbers),
        "boxes": profile.box_stats(df, S.LABEL, ["CPU_Usage", "Memory_Usage", "Temperature"]),
    }


def run(
    spark: SparkSession,
    source: str,
    model_path: str,
    fmt: str = "csv",
    preset: str = "full",
    max_fit_rows: int | None = None,
    output: str | None = None,
) -> dict[str, DataFrame]:
    """Train on the readings at ``source``, save the best model to ``model_path`` and
    score the fleet and the built-in scenarios with it.

    Rows that fail validation are set aside as ``rejected``. With ``output`` each
    resulting table is also written below that path as parquet.
    """
    raw = telemetry.read_telemetry(spark, source, fmt)
    if fmt in ("csv", "json"):
        raw = reread(raw)  # the text is parsed once for all tables
    labelled = [*quality.input_rules(), ("missing:" + S.LABEL, raw[S.LABEL].isNotNull())]
    valid, rejected = quality.validate(raw, labelled)
    train, test = split.stratified_split(valid, S.KEY, S.LABEL)
    fitted, board = training.train_candidates(train, test, preset=preset, max_fit_rows=max_fit_rows)
    name, model = training.choose_model(fitted, board)
    models.save_model(model, model_path)
    used = models.active_model_name(model)
    report = scoring.score_fleet(test, model)
    tables = {
        **profile_tables(raw),
        "rejected": rejected,
        "leaderboard": evaluation.mark_active(board, name),
        "report": evaluation.classification_report(report, S.LABEL, "prediction"),
        "fleet_summary": fleet.fleet_summary(raw, active_model=used),
        "scored": scoring.score_fleet(valid, model),
        "scenarios": scoring.score_fleet(telemetry.scenarios(spark), model),
    }
    if output:
        for table, df in tables.items():
            telemetry.write_telemetry(df, f"{output}/{table}", mode="overwrite")
    return tables
