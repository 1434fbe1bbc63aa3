"""Table profiling: shape, missing values, summary, counts, correlation, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicepulse.functions.rules import known
from devicepulse.operators.ranks import (
    at_ranks,
    bracketed,
    melt,
    quantiles,
    sketch_size,
    sketches,
)
from devicepulse.session import local_table, match

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, a 0/1 label included."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by a key."""
    return df.orderBy(order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("int").alias("n_columns")
    )


def _present(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return known(F.col(c)).isNotNull() if floating else F.col(c).isNotNull()


def column_info(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: position, name, non-null count and type, in one pass."""
    cols = cols or df.columns
    counts = df.agg(*[F.count_if(_present(df, c)).alias(c) for c in cols])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.col(f"`{c}`").alias("non_null"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
        )
        for i, c in enumerate(cols)
    ]
    return counts.select(F.inline(F.array(*rows)))


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: how many cells are NULL or NaN, in one pass."""
    cols = cols or df.columns
    counts = df.agg(*[F.count_if(~_present(df, c)).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "missing")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first and ties by value; NULL and NaN are not counted."""
    counts = df.where(_present(df, col)).groupBy(col).agg(F.count(col).alias("n"))
    return counts.where("n > 0").orderBy(F.desc("n"), col)


def describe(df: DataFrame, cols: list[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column.

    Quartiles are exact, with linear interpolation, and take a second scan. With
    ``accuracy`` there is only one, and they are values of the column whose rank is
    off by rows/accuracy or less, with 99 % confidence.
    """
    if accuracy:
        out = sketches(df, cols, size=sketch_size(1 / accuracy))
        out = out.withColumn("_at", at_ranks(list(QUARTILES.values())))
        out = out.withColumns({q: F.get("_at", F.lit(i)) for i, q in enumerate(QUARTILES)})
    else:
        out = bracketed(sketches(df, cols), QUARTILES)
        out = match(out, quantiles(df, cols, QUARTILES, sketched=out), ["column"])
    # A table without rows still has a row per column here.
    named = T.StructType([T.StructField("column", T.StringType())])
    every = local_table(df.sparkSession, [(c,) for c in cols], named)
    out = match(every, out, ["column"])
    out = out.withColumn("count", F.coalesce("n", F.lit(0)))
    return out.select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in long form (x, y, corr).

    Each pair uses the rows where both are present. The correlation with a column
    that is constant there is NULL.

    A first pass finds the mean of each column and whether it has gaps. The second
    sums products of centred values: the sums of a column without gaps are shared
    by all its pairs, and only half of the matrix is computed.
    """
    numbers = df.select(*[known(F.col(c)).alias(c) for c in cols])
    first = numbers.agg(
        F.count("*").alias("n"),
        *[
            F.struct(F.count(c), F.avg(c), F.min(c) == F.max(c)).alias(c)
            for c in cols
        ],
    ).first()
    gaps = {c for c in cols if first[c][0] < first["n"]}
    flat = {c for c in cols if first[c][1] is None or first[c][2]}
    centred = numbers.select(*[(F.col(c) - F.lit(first[c][1] or 0.0)).alias(c) for c in cols])

    def paired(c, other):
        """The values of ``c`` in the rows of the pair."""
        return F.when(F.col(other).isNotNull(), F.col(c)) if other in gaps else F.col(c)

    def correlation(x, y):
        if x in flat or y in flat:
            return F.lit(None).cast("double")
        a, b = paired(x, y), paired(y, x)
        whole = x not in gaps and y not in gaps
        n = F.count("*") if whole else F.count(a * b)
        sum_a, sum_b = F.sum(a), F.sum(b)
        spread_a = n * F.sum(a * a) - sum_a * sum_a
        spread_b = n * F.sum(b * b) - sum_b * sum_b
        corr = F.try_divide(n * F.sum(a * b) - sum_a * sum_b, F.sqrt(spread_a * spread_b))
        if whole:
            return corr
        # A column may be constant within the pair, though not on its own.
        return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), corr)

    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), correlation(x, y).alias("corr"))
        for i, x in enumerate(cols)
        for y in cols[i:]
    ]
    half = centred.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = half.select(F.explode(F.array_distinct(both)).alias("pair"), "corr")
    return pairs.select("pair.x", "pair.y", "corr")


def box_fences(df: DataFrame, group: str, cols: list[str], k: float) -> DataFrame:
    """Quartiles and fences per group and column."""
    found = quantiles(df, cols, QUARTILES, [group]).where(F.col(group).isNotNull())
    spread = F.col("q75") - F.col("q25")
    return found.withColumns(
        {
            "low_fence": F.col("q25") - F.lit(k) * spread,
            "high_fence": F.col("q75") + F.lit(k) * spread,
        }
    )


def box_stats(df: DataFrame, group: str, cols: list[str], k: float = 1.5) -> DataFrame:
    """What a box plot shows, per group and column: quartiles, whiskers and number
    of outliers.

    A whisker ends at the last value inside ``k`` interquartile ranges, but never
    inside the box. Groups that are NULL are left out.
    """
    keys = [group, "column"]
    rows = match(melt(df, cols, [group]), box_fences(df, group, cols, k), keys, "inner")
    value = F.col("value")
    inside = value.between(F.col("low_fence"), F.col("high_fence"))
    boxes = rows.groupBy(*keys, *QUARTILES).agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, value)).alias("_low"),
        F.max(F.when(inside, value)).alias("_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return boxes.select(
        *keys,
        "n",
        *QUARTILES,
        F.least("_low", "q25").alias("low_whisker"),
        F.greatest("_high", "q75").alias("high_whisker"),
        "outliers",
    )


def box_outliers(df: DataFrame, group: str, col: str, k: float = 1.5) -> DataFrame:
    """The rows of ``df`` outside the fences of their group, with the fences."""
    fences = box_fences(df, group, [col], k).drop("column", *QUARTILES)
    value = known(F.col(col))
    outside = (value < F.col("low_fence")) | (value > F.col("high_fence"))
    return match(df, fences, [group], "inner").where(outside)
