"""Exact stratified hold-out split and class weights."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicepulse.session import kept, match, names

TEST = "_is_test"
# Length of an MD5 digest in hexadecimal digits.
WIDTH = 32


def _told(columns: list[str]) -> Column:
    """All values as one text, with lengths and marks for NULL, so that no two rows agree."""
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    marked = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.concat(*[F.coalesce(m, F.lit("-")) for m in marked])


def key_hash(key: str | list[str], seed: int) -> Column:
    """Hex digest that orders rows at random but reproducibly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *names(key)))


def mark_test(
    df: DataFrame,
    key: str | list[str],
    label: str,
    test_size: float = 0.2,
    seed: int = 42,
    digits: int = 5,
    together: bool = False,
) -> DataFrame:
    """Add a flag that is true for exactly ``round(test_size * n)`` rows per class.

    The test rows of a class are those with the smallest digests of the key; rows with
    the same key, NULL too, are ordered by a digest of all their columns. So the flag is
    a comparison with one cut per class and moves no row. Only rows that are equal in
    every column stay together, which can shift the cut by the copies of one row.
    With ``together`` all rows of a key and class do, and it can shift by one such group.
    A NULL label is a class of its own.

    The cut is found from counts per leading digits, at most 16**digits per class, then
    among the rows that share those of the cut, and so on until the cut falls between two
    counts. With distinct keys one or two steps are enough.
    """
    key_digest = key_hash(key, seed)
    # Also tells apart keys that differ only in where a NULL stands.
    row_digest = F.md5(_told(names(key) if together else df.columns))

    def lead(n: int) -> Column:
        if n <= WIDTH:
            return F.substring(key_digest, 1, n)
        return F.concat(key_digest, F.substring(row_digest, 1, n - WIDTH))

    by_label = Window.partitionBy(label)
    so_far = by_label.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    # Two steps leave one digest in 16**(2 * digits), the third step tells those apart.
    steps = [min(digits, WIDTH), min(2 * digits, WIDTH), WIDTH]
    steps += [WIDTH + n for n in steps]
    found, still_open, before = [], None, 0
    for end in sorted(set(steps)):
        if still_open is None:
            counts = df.groupBy(label, lead(end).alias("_cut")).agg(F.count("*").alias("_rows"))
            goal = F.round(F.lit(test_size) * F.sum("_rows").over(by_label)).cast("long")
            counts = counts.withColumn("_want", goal)
        else:
            edge = still_open.select(label, F.col("_cut").alias("_edge"), "_want")
            inside = match(df, edge, [label], "inner").where(lead(before) == F.col("_edge"))
            counts = inside.groupBy(label, "_want", lead(end).alias("_cut")).agg(
                F.count("*").alias("_rows")
            )
        reached = counts.withColumn("_upto", F.sum("_rows").over(so_far))
        reached = reached.where("_want > _upto - _rows AND _want <= _upto")
        left = F.col("_want") - F.col("_upto") + F.col("_rows")
        reached = kept(reached.select(label, "_cut", "_rows", left.alias("_want")))
        found.append(reached.where("_want = _rows"))
        still_open, before = reached.where("_want < _rows"), end
        if still_open.isEmpty():
            break
    else:
        found.append(still_open)
    cuts = kept(functools.reduce(DataFrame.union, found).select(label, "_cut"))
    flagged = match(df.withColumn("_lead", lead(before)), cuts, [label])
    is_test = F.coalesce(F.expr("left(_lead, length(_cut)) <= _cut"), F.lit(False))
    return flagged.withColumn(TEST, is_test).drop("_lead", "_cut")


def stratified_split(
    df: DataFrame,
    key: str | list[str],
    label: str,
    test_size: float = 0.2,
    seed: int = 42,
    together: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the class proportions of ``df`` kept exactly."""
    flagged = mark_test(df, key, label, test_size, seed, together=together)
    return flagged.where(~F.col(TEST)).drop(TEST), flagged.where(TEST).drop(TEST)


def split_counts(df: DataFrame, key: str | list[str], label: str, **options) -> DataFrame:
    """Rows per class and side of the split."""
    flagged = mark_test(df, key, label, **options)
    return flagged.groupBy(label).agg(
        F.count_if(~F.col(TEST)).alias("n_train"), F.count_if(F.col(TEST)).alias("n_test")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight rows / (classes * rows of the class), one row per class."""
    counts = kept(df.groupBy(label).agg(F.count(label).alias("n")).where("n > 0"))
    # One row, whatever the number of classes; it enters the plan as constants.
    rows, classes = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.withColumn("weight", F.lit(rows or 0) / (F.lit(classes) * F.col("n")))


def balanced_weights(df: DataFrame, label: str, weight: str = "class_weight") -> DataFrame:
    """Add the balanced class weight of each row; rows without a label are kept
    with no weight."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(weight))
    return match(df, kept(weights), [label])
