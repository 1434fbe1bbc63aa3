"""The scalar rules as SQL functions, for users who write ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from devicepulse import schema as S


def sql_functions() -> dict[str, str]:
    """Function name to its ``CREATE`` statement. The bodies are SQL, so the
    optimizer inlines them; no Python runs per row."""
    params = ", ".join(f"{c.lower()} DOUBLE" for c in S.RISK_WEIGHTS)
    score = " + ".join(f"{w}D * ({c.lower()} / {s}D)" for c, (w, s) in S.RISK_WEIGHTS.items())
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return {
        "risk_score": f"{create} risk_score({params}) RETURNS DOUBLE RETURN {score}",
        "risk_label": (
            f"{create} risk_label(score DOUBLE) RETURNS INT RETURN "
            f"CAST(score > {S.FAILURE_THRESHOLD}D AND NOT isnan(score) AS INT)"
        ),
        "risk_band": (
            f"{create} risk_band(p DOUBLE) RETURNS STRING RETURN CASE "
            f"WHEN p IS NULL THEN NULL WHEN p < {S.LOW_BELOW}D THEN 'LOW' "
            f"WHEN p < {S.HIGH_FROM}D THEN 'MEDIUM' ELSE 'HIGH' END"
        ),
        "device_type": (
            f"{create} device_type(name STRING) RETURNS STRING RETURN "
            "CASE WHEN lower(trim(name)) = 'router' THEN 'Router' ELSE 'Switch' END"
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    statements = sql_functions()
    for statement in statements.values():
        spark.sql(statement)
    return list(statements)
