"""Helpers of the operators: tables in the shared folder, ranks, connected components.

Everything a later job reads more than once is written as Parquet below the folder
named in ``spark.checkpoint.dir``, so it survives lost executors. Where that setting
is missing, as in tests, a folder in the warehouse is used, which is shared as well.
"""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most ``rows`` texts at once to a Python worker, unless the session already
    asks for fewer: workers live on with the memory that their largest batch took."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def slices(spark: SparkSession) -> int:
    """How many salts to spread a hot key over: the shuffle's own partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character as it is. NULL is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL equal to NULL, with the keys of ``left`` only."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, functools.reduce(operator.and_, on), how).drop(
        *[f"_right_{k}" for k in keys]
    )


def ranked(df: DataFrame, by: list[str], order: list[str], measures: list[str], tag: str) -> DataFrame:
    """Add, for each measure m, ``m_before``: its sum over the rows of the same group
    that come earlier in ``order``, and ``m_total``: its sum over the group.

    Rows are range-partitioned by (``by``, ``order``) and written once with the number
    of their slice. Each slice adds up its own rows, and the totals of the slices before
    it follow from one row per slice and group, so no task holds a whole group. Rows
    that tie in ``order`` come in any order. ``df`` should be narrow and cheap to read
    twice, as the range bounds are sampled.
    """
    placed = written(
        df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()), tag
    )
    group, inside = Window.partitionBy(*by), Window.partitionBy(*by, "_slice")
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    above = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = placed.groupBy(*by, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = offsets.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(m).over(earlier), zero).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
    )
    summed = placed.withColumns(
        {f"_{m}_above": F.coalesce(F.sum(m).over(above), zero) for m in measures}
    )
    return (
        same(summed, offsets, [*by, "_slice"])
        .withColumns({f"{m}_before": F.col(f"_{m}_offset") + F.col(f"_{m}_above") for m in measures})
        .drop("_slice", *[f"_{m}_{x}" for m in measures for x in ("offset", "above")])
    )


def components(links: DataFrame, tag: str) -> DataFrame:
    """Rows (``node``, ``root``) for every node of ``links`` (``a``, ``b``): the root is
    the same for all nodes that links connect.

    Each round gives every node the smallest of itself and its neighbours, a combined
    minimum, and replaces the nodes of all links by it; links inside a node vanish. A
    star with any number of leaves is gone after one round, a path shrinks by a factor.
    At the end the rounds are applied to each other. Links and labels stay in tables;
    the driver only learns whether links are left.
    """
    maps: list[DataFrame] = []
    links = written(links.select("a", "b").where("a <> b").distinct(), f"{tag}-links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("root")
        )
        smaller = written(smaller, f"{tag}-labels")
        maps.append(smaller)
        low, high = (
            smaller.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
            for c in ("a", "b")
        )
        links = (
            links.join(low, "a")
            .join(high, "b")
            .select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            .where("a <> b")
            .distinct()
        )
        links = written(links, f"{tag}-links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = labels.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")
        )
    return labels
