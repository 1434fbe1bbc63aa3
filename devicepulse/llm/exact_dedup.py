"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Local: each scan task combines its own equal texts (the map side of the first
   aggregate, whose salt is the number of the scan partition).
2. Salted: a group is merged per (digest, salt, text), so that a text that a third of
   all rows share is spread over as many tasks as there are salts.
3. Global: the salt winners of a text, at most one row per salt, meet in a window.

The full normalised text is part of the key at every stage; the digest only spreads
the work. A group's row numbers leave stage 2 as lists of one salt each, and are dealt
out by salt again before they become rows.

Results that are defined for odd input: NULL text counts as empty; NULL ids are the
smallest; of rows that repeat both id and text one stays; an empty table gives no rows;
other columns are ignored (``decisions``) or kept whatever their names (``survivors``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicepulse.llm.shared import lower_ascii, slices


def _salted(df: DataFrame, text: Column, id_col: str, *keep: Column) -> DataFrame:
    """(``text``, ``digest``, ``salt``, ``id`` and ``keep``) per row."""
    parts = slices(df.sparkSession)
    rows = df.select(
        lower_ascii(text).alias("text"),
        F.col(id_col).alias("id"),
        F.pmod(F.spark_partition_id(), F.lit(parts)).alias("salt"),
        *keep,
    )
    return rows.withColumn("digest", F.sha2("text", 256))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id`` (the largest id with this text),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    best = F.max(F.struct("id")).alias("best")  # a struct, so that a NULL id counts
    merged = (
        _salted(docs, F.col(text_col), id_col)
        .groupBy("digest", "salt", "text")
        .agg(best, F.count("*").alias("n"), F.collect_list(F.struct("id")).alias("ids"))
    )
    equal = Window.partitionBy("digest", "text")
    winners = merged.select(
        "digest",
        "salt",
        "ids",
        F.max("best").over(equal)["id"].alias("keep_id"),
        F.sum("n").over(equal).alias("group_size"),
        (F.row_number().over(equal.orderBy(F.desc("best"), "salt")) == 1).alias("first"),
    )
    dealt = winners.repartition("digest", "salt")
    rows = dealt.select("*", F.posexplode(F.sort_array("ids", False)).alias("place", "row"))
    return rows.select(
        F.col("row.id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("first") & (F.col("place") == 0)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    whole = F.max_by("row", F.struct("id", F.xxhash64("row"))).alias("row")
    local = _salted(docs, F.col(text_col), id_col, row.alias("row"))
    merged = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), whole)
    final = merged.groupBy("digest", "text").agg(whole)
    return final.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document with the decision on it."""
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), grouped AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM grouped
"""
