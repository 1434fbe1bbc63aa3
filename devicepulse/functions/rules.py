"""Risk score, label, bands and advisories as Column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.session import local_table


def known(c: Column) -> Column:
    """A double with NaN turned into NULL. Spark sorts NaN above every number, so
    a NaN reading would otherwise pass every ``>`` rule."""
    number = c.cast("double")
    return F.when(~F.isnan(number), number)


def risk_score(weights: dict[str, tuple[float, float]] = S.RISK_WEIGHTS) -> Column:
    """Sum of ``weight * column / scale``; NULL if a reading is NULL."""
    terms = [F.lit(w) * (F.col(c).cast("double") / F.lit(s)) for c, (w, s) in weights.items()]
    return functools.reduce(operator.add, terms)


def as_probability(score: Column) -> Column:
    """A score clipped to 0..1, for use where a probability is expected."""
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def threshold_label(score: Column, threshold: float = S.FAILURE_THRESHOLD) -> Column:
    """1 strictly above the threshold, 0 otherwise, NULL for a NULL score. A NaN
    score is not above any threshold and gives 0."""
    return ((score > F.lit(threshold)) & ~F.isnan(score)).cast("int")


def risk_band(p: Column, low: float = S.LOW_BELOW, high: float = S.HIGH_FROM) -> Column:
    """LOW below ``low``, MEDIUM below ``high``, HIGH otherwise; NULL stays NULL
    and NaN is HIGH."""
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < F.lit(low), F.lit("LOW"))
        .when(p < F.lit(high), F.lit("MEDIUM"))
        .otherwise(F.lit("HIGH"))
    )


def fires(column: str, limit: float) -> Column:
    """Whether an advisory rule fires; false for a missing reading."""
    return F.coalesce(known(F.col(column)) > F.lit(limit), F.lit(False))


def advisories(
    rules: list[tuple[str, str, float]] = S.ADVISORY_RULES,
    texts: dict[str, str] | None = S.ADVISORY_TEXTS,
) -> Column:
    """Ordered array of the texts (keys, if ``texts`` is None) of the rules that
    fire, or the one fallback when none does."""
    say = (lambda key: F.lit(texts[key])) if texts else F.lit
    hits = [(key, fires(column, limit)) for key, column, limit in rules]
    any_hit = functools.reduce(operator.or_, [hit for _, hit in hits])
    found = [F.when(hit, say(key)) for key, hit in hits]
    return F.array_compact(F.array(*found, F.when(~any_hit, say(S.NO_ADVISORY))))


def round_measurements(
    df: DataFrame, cols: list[str] = S.MEASUREMENTS, places: int = 2, half_even: bool = False
) -> DataFrame:
    """Round columns in place: half away from zero, or half to even on request."""
    rounding = F.bround if half_even else F.round
    return df.withColumns({c: rounding(F.col(c), places) for c in cols})


def band_details(df: DataFrame, risk: str = "risk") -> DataFrame:
    """Add colour, status text and action text; rows without a band keep NULLs.

    The dimension has exactly three rows, hence the broadcast.
    """
    dim = local_table(df.sparkSession, S.BANDS, S.BANDS_SCHEMA).withColumnRenamed("risk", risk)
    return df.join(F.broadcast(dim), risk, "left")
