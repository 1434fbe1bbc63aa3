"""Scoring requests and responses as JSON text columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions.rules import known
from devicepulse.functions.text import normalize_type

NO_MODEL = "None (Model not trained)"


# Each field is read as a variant, which tells an absent key, a null, a number and
# a text apart; text that is not an object ends up in the last field.
PARSED = ", ".join(f"{c} variant" for c in S.FEATURES) + ", _malformed string"


def decode_requests(df: DataFrame, col: str = "request") -> DataFrame:
    """Add the feature columns and ``reasons`` for a column of JSON objects.

    A missing key takes its default, while an explicit null or a value of the
    wrong type is a reason. Numbers and numeric text are both read; a counter
    truncates a number such as 3.7 but not the text "3.7". Any text is accepted as
    a device type. Text that is not a JSON object is malformed. Empty ``reasons``
    mean the row can be scored.
    """
    fields = F.from_json(F.col(col), PARSED, {"columnNameOfCorruptRecord": "_malformed"})
    out = df.withColumn("_parsed", fields)
    given = {c: F.col(f"_parsed.{c}") for c in S.FEATURES}
    malformed = F.col("_parsed").isNull() | F.col("_parsed._malformed").isNotNull()
    nothing_known = functools.reduce(operator.and_, [g.isNull() for g in given.values()])
    no_keys = F.size(F.json_object_keys(F.col(col))) == 0
    out = out.withColumn(
        "_fault",
        F.when(malformed, F.lit("malformed_json")).when(
            nothing_known & no_keys, F.lit("empty_request")
        ),
    )
    usable = F.col("_fault").isNull()
    features, bad = {}, [F.col("_fault")]
    for name, value in given.items():
        default = F.lit(S.REQUEST_DEFAULTS[name])
        if name in S.CATEGORICAL_FEATURES:
            text = F.try_variant_get(value, "$", "string")
            filled = normalize_type(F.when(value.isNull(), default).otherwise(text))
        else:
            kind = "bigint" if name in S.COUNTERS else "double"
            number = F.try_variant_get(value, "$", kind)
            number = known(number) if kind == "double" else number
            filled = F.when(value.isNull(), default.cast(kind)).otherwise(number)
            bad.append(F.when(usable & F.col(name).isNull(), F.lit(f"not_a_number:{name}")))
        features[name] = F.when(usable, filled)
    reasons = F.array_compact(F.array(*bad))
    return out.withColumns(features).withColumn("reasons", reasons).drop("_parsed", "_fault")


def encode_responses(df: DataFrame, reasons: str | None = None) -> DataFrame:
    """Add ``response``: the scored row as JSON, or ``{"error": …}`` where
    ``reasons`` is not empty."""
    body = F.struct(
        F.lit(True).alias("success"),
        F.col("prediction").cast("int").alias("prediction"),
        "probability",
        "risk",
        "risk_color",
        "status_text",
        "advisory",
        "model_used",
    )
    response = F.to_json(body)
    if reasons:
        failure = F.struct(F.array_join(reasons, ", ").alias("error"))
        response = F.when(F.size(reasons) == 0, response).otherwise(F.to_json(failure))
    return df.withColumn("response", response)
