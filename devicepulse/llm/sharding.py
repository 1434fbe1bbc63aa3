"""Contiguous shards of near equal bytes, in DataFrame functions only.

Rows are put in one global order, range-partitioned by it, and every partition adds up
its own sizes. The running sum of the partitions' totals, one row per partition, turns
these into the global byte position of each row, and the shard of a row is the one of
``shards`` equal stretches of bytes that its middle falls into. A shard therefore
misses its target by at most the size of the two rows at its ends.

The order is by a hash of the text, then by id: copies of a text lie next to each other
and share a shard unless a cut falls among them, and a text that a third of all rows
share is still split by id over many partitions and shards.

Results that are defined for odd input: NULL text has no bytes; rows that tie in the
order are placed in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicepulse.llm.shared import ranked, written

# Bytes that a document takes besides its text.
HEADER = 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size in bytes, CRC-32 and a hash of the text per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(HEADER)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
    )


def byte_shards(rows: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` and ``slot``, the gapless place in the shard, to ``rows``."""
    counted = rows.withColumn("_one", F.lit(1).cast("long"))
    placed = ranked(counted, [], order, [size, "_one"], "shards")
    middle = 2 * F.col(f"{size}_before") + F.col(size)
    cut = F.expr(
        f"CAST((2 * {size}_before + {size}) * {shards} DIV greatest(2 * {size}_total, 1) AS INT)"
    )
    placed = placed.withColumn("shard", F.least(cut, F.lit(shards - 1))).where(middle.isNotNull())
    # One row per shard: as many as the parameter says.
    starts = placed.groupBy("shard").agg(F.min("_one_before").alias("_start"))
    return (
        placed.join(F.broadcast(starts), "shard")
        .withColumn("slot", F.col("_one_before") - F.col("_start"))
        .drop("_start", *[f"{m}_{x}" for m in (size, "_one") for x in ("before", "total")], "_one")
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, size, CRC-32 of the text, shard and slot of every row of ``docs``."""
    narrow = written(sized(docs, id_col, text_col), "sizes")
    placed = byte_shards(narrow, shards, ["hash", "id"])
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
