"""Input validation: rows that break a rule are set aside with the reasons."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S

Rule = tuple[str, Column]


def input_rules(ranges: dict[str, tuple] = S.INPUT_RANGES) -> list[Rule]:
    """The default rules: a known device type, every reading present and in range.
    NaN counts as missing."""
    rules = [("bad:Device_Type", F.col("Device_Type").isin(S.DEVICE_TYPES))]
    for c, (low, high) in ranges.items():
        value = F.col(c)
        gap = value.isNull() if c in S.COUNTERS else value.isNull() | F.isnan(value)
        in_range = value >= F.lit(low)
        if high is not None:
            in_range = in_range & (value <= F.lit(high))
        rules.append((f"missing:{c}", ~gap))
        rules.append((f"out_of_range:{c}", gap | in_range))
    return rules


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def add_reasons(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``reasons``, the names of the rules a row breaks, in rule order. A rule
    is a name and a condition that must hold; NULL counts as not holding."""
    rules = input_rules() if rules is None else rules
    broken = [F.when(~_holds(condition), F.lit(name)) for name, condition in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def validate(df: DataFrame, rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one, with ``reasons``). Rows are
    rejected, never clamped.

    The first filter is a plain conjunction, which stops at the first broken rule
    and can reach the scan.
    """
    rules = input_rules() if rules is None else rules
    kept = functools.reduce(operator.and_, [condition for _, condition in rules])
    return df.where(kept), add_reasons(df.where(~_holds(kept)), rules)
