"""Identifier, coercion and formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from devicepulse.functions.rules import known


def device_id(n: Column) -> Column:
    """``DEV-`` and the number, padded to five digits and wider when it needs to be."""
    digits = n.cast("string")
    return F.concat(
        F.lit("DEV-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0"))
    )


def normalize_type(c: Column, mode: str = "lenient") -> Column:
    """Canonical device type. ``lenient`` turns everything but a router into a
    switch, NULL too; ``strict`` gives NULL for any other text."""
    name = F.lower(F.trim(c.cast("string")))
    router = F.when(name == "router", F.lit("Router"))
    if mode == "lenient":
        return router.otherwise(F.lit("Switch"))
    if mode == "strict":
        return router.when(name == "switch", F.lit("Switch"))
    raise ValueError(f"unknown mode: {mode}")


def to_double(c: Column, default: float | None = None) -> Column:
    """Text to double; ``default`` where it is not a number (or is NaN)."""
    return F.coalesce(known(F.trim(c).try_cast("double")), F.lit(default).cast("double"))


def to_int(c: Column, default: int | None = None) -> Column:
    """Text to a 64-bit integer; ``default`` where it is not a whole number, as for ``"3.7"``."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def with_default(c: Column, default: object) -> Column:
    """Trimmed text, or ``default`` where it is blank or NULL."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(str(default)))


def percent(p: Column) -> Column:
    """A share as text with two decimals: 0.84 is ``84.00%``."""
    return F.format_string("%.2f%%", p * 100)


def thousands(n: Column) -> Column:
    """A whole number as text with thousands separators."""
    return F.format_number(n, 0)
