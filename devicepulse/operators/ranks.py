"""Exact running totals and quantiles over sorted values, without a window that
holds all rows.

Running totals start from one row per distinct value with its counts, which Spark
combines before the shuffle, so a value shared by a third of all rows is one row.
Those rows are range-partitioned by value and stored. Each slice then sums its own
rows, and the totals of the slices before it, one row per slice, are added.

Quantiles first take sketches, which say between which values each of them must
lie. Only values between those are told apart; all others are merely counted. So
two scans and a small shuffle are enough, however many distinct values there are.
The sketches of the scan tasks are merged level by level, so no task meets all of them.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicepulse.functions.rules import known
from devicepulse.session import kept, match, names, stored

# Size parameter of a sketch. A larger one means fewer values to rank but more bytes to
# shuffle: about 100 KB per scan task and column with this one.
SIZE = 4_000
# Brackets reach over the narrowest of these shares of the rows, to both sides, that is
# SAFETY times the error of the sketch and two ranks more.
SAFETY = 3
WIDTHS = [0.005 * 2**i for i in range(9)]


def running_totals(
    counts: DataFrame, by: list[str], order: list[str], measures: list[str]
) -> DataFrame:
    """For each measure m add ``m_before``, its sum over the rows of the same group
    that come earlier in ``order``, and ``m_total``, its sum over the group.

    ``counts`` has one row per (``by``, ``order``). The result is stored, so its
    users may read it more than once.
    """
    slices = stored(
        counts.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id())
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice a group reaches into: at most slices + groups rows.
    offsets = slices.groupBy(*by, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = offsets.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
    )
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = match(slices, kept(offsets), [*by, "_slice"])
    return joined.withColumns(
        {
            f"{m}_before": F.col(f"_{m}_offset")
            + F.coalesce(F.sum(m).over(inside), F.lit(0))
            for m in measures
        }
    ).drop("_slice", *[f"_{m}_offset" for m in measures])


def melt(df: DataFrame, cols: list[str], by: str | list[str] | None = None) -> DataFrame:
    """Long form (``by``, ``column``, ``value``) without missing values."""
    numbers = df.select(*names(by), *[known(F.col(c)).alias(c) for c in cols])
    return numbers.unpivot(names(by), cols, "column", "value").where("value IS NOT NULL")


def rank_error(size: int) -> float:
    """Share of the rows by which ranks from a KLL sketch are off, with 99 % confidence."""
    return 2.296 / size**0.9021


def sketch_size(error: float) -> int:
    """The size of a sketch with this ``rank_error``, within what the sketches allow."""
    return min(max(math.ceil((2.296 / error) ** (1 / 0.9021)), 8), 65_535)


def sketches(
    df: DataFrame, cols: list[str], by: str | list[str] | None = None, size: int = SIZE
) -> DataFrame:
    """One row per group and column: ``n``, ``mean``, sample deviation ``std``, ``min``,
    ``max`` and a KLL ``sketch`` of the values that are there.

    One scan. The sketches of the scan tasks meet level by level: by slots, as many as the
    shuffle has partitions, then by the remainder of the slot, then by group. A group reads
    no more than ``fan_in`` of the slots at once.
    """
    by = names(by)
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = df.select(
        *by,
        *[known(F.col(c)).alias(c) for c in cols],
        F.pmod(F.spark_partition_id(), F.lit(slots)).alias("_slot"),
    )
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.var_pop(c).alias("var"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.kll_sketch_agg_double(c, size).alias("sketch"),
        )
        for c in cols
    ]
    per_slot = numbers.groupBy(*by, "_slot").agg(F.array(*parts).alias("parts"))
    per_slot = per_slot.select(*by, "_slot", F.inline("parts"))
    per_slot = per_slot.withColumn("_slot", F.pmod("_slot", F.lit(fan_in(slots))))
    merged = _merged(_merged(per_slot, [*by, "column", "_slot"], size), [*by, "column"], size)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("var") * (F.col("n") / (F.col("n") - 1))))
    return merged.select(*by, "column", "n", "mean", std.alias("std"), "min", "max", "sketch")


def fan_in(slots: int) -> int:
    """How many parts the second level of ``sketches`` has: no merge reads more than this
    number of sketches."""
    return math.ceil(math.sqrt(slots))


def _merged(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row per ``keys`` of ``n``, ``mean``, ``var``, ``min``, ``max`` and ``sketch``."""
    there = F.when(F.col("n") > 0, F.struct("n", "mean", "var"))
    merged = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", size).alias("sketch"),
        F.collect_list(there).alias("parts"),  # at most one per sketch
    )

    def total(of):
        return F.aggregate("parts", F.lit(0.0), lambda so_far, part: so_far + part["n"] * of(part))

    merged = merged.withColumn("mean", F.try_divide(total(lambda part: part["mean"]), F.col("n")))
    spread = total(lambda part: part["var"] + F.pow(part["mean"] - F.col("mean"), F.lit(2)))
    return merged.withColumn("var", F.try_divide(spread, F.col("n"))).drop("parts")


def at_ranks(ranks: list[float]) -> Column:
    """The values of ``sketch`` at these shares of the rows; NULL without values."""
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for r in ranks]))
    return F.when(F.col("n") > 0, values)


def bracketed(sketched: DataFrame, probabilities: dict[str, float], size: int = SIZE) -> DataFrame:
    """What ``sketches`` returns with ``edges`` for the sketch: two values per quantile
    that it lies between. Stored, as a sketch made again may differ."""
    ranks = [
        min(max(p + side * width, 0.0), 1.0)
        for p in probabilities.values()
        for side in (-1, 1)
        for width in WIDTHS
    ]
    need = F.lit(SAFETY * rank_error(size)) + F.lit(2.0) / F.greatest("n", F.lit(1))
    level = F.ceil(F.log2(need / F.lit(WIDTHS[0]))).cast("int")
    level = F.least(F.greatest(level, F.lit(0)), F.lit(len(WIDTHS) - 1))
    points = sketched.withColumns({"_points": at_ranks(ranks), "_level": level}).drop("sketch")
    edges = [
        F.get("_points", F.lit(i * len(WIDTHS)) + F.col("_level"))
        for i in range(2 * len(probabilities))
    ]
    return stored(points.withColumn("edges", F.array(*edges)).drop("_points", "_level"))


def _brackets(sketched: DataFrame, keys: list[str], how_many: int) -> DataFrame:
    """Columns ``_low0, _high0, _low1, …`` per key."""
    sides = []
    for i in range(how_many):
        sides.append(F.get("edges", F.lit(2 * i)).alias(f"_low{i}"))
        sides.append(F.get("edges", F.lit(2 * i + 1)).alias(f"_high{i}"))
    return sketched.select(*keys, *sides)


def _ranked(
    long: DataFrame,
    keys: list[str],
    brackets: DataFrame | None,
    how_many: int,
) -> DataFrame:
    """Values with their counts ``n``, ``n_before`` and ``n_total``. A value outside
    every bracket is ``coarse``: counted at the end of the bracket before it.
    """
    value, coarse = F.col("value"), F.lit(False)
    if brackets is not None:
        long = match(long, kept(brackets), keys)
        outside = []
        before = F.lit(-math.inf)
        for i in range(how_many):
            low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
            outside += [(value < low, before, True), (value <= high, value, False)]
            before = high
        value, coarse = before, F.lit(True)
        for condition, stand_in, is_coarse in reversed(outside):
            value = F.when(condition, stand_in).otherwise(value)
            coarse = F.when(condition, F.lit(is_coarse)).otherwise(coarse)
    placed = long.select(*keys, value.alias("value"), coarse.alias("coarse"))
    counts = placed.groupBy(*keys, "value", "coarse").agg(F.count("*").alias("n"))
    return running_totals(counts, keys, ["value", "coarse"], ["n"])


def _pick(ranked: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation; NULL where one falls on a coarse value."""

    def at(rank):
        here = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(here & ~F.col("coarse"), F.col("value")))

    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("n_total") - 1)
        picks += [
            at(F.floor(position)).alias(f"_{name}_low"),
            at(F.ceil(position)).alias(f"_{name}_high"),
            F.max(position - F.floor(position)).alias(f"_{name}_part"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_{name}_low")
                + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in probabilities
        ],
    )


def quantiles(
    df: DataFrame,
    cols: list[str],
    probabilities: dict[str, float],
    by: str | list[str] | None = None,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group and column and
    one named column per quantile. Groups without values have no row.

    ``sketched`` may be given if a caller has it: what ``bracketed`` returns. Should a
    quantile lie outside its bracket, which is most unlikely, all values are ranked.
    """
    keys = [*names(by), "column"]
    long = melt(df, cols, by)
    if sketched is None:
        sketched = bracketed(sketches(df, cols, by), probabilities)
    brackets = _brackets(sketched.where("n > 0"), keys, len(probabilities))
    narrow = _ranked(long, keys, brackets, len(probabilities))
    found = kept(_pick(narrow, keys, probabilities))
    missed = functools.reduce(operator.or_, [F.col(name).isNull() for name in probabilities])
    if found.where(missed).isEmpty():
        return found
    return kept(_pick(_ranked(long, keys, None, 0), keys, probabilities))
