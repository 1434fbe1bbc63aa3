"""A stream sorted into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from devicepulse.operators.quality import Rule, add_reasons

SIDES = ["accepted", "rejected"]


def write_batch(batch: DataFrame, number: int, folder: str, rules: list[Rule] | None = None) -> None:
    """Write one batch to both sides, with the ``reasons`` of each row.

    Both sides are partitions of one table and come from one scan and one commit. A
    batch owns its partitions and replaces them as a whole, so one that is replayed
    after a failure leaves each of its rows once.
    """
    taken = {"side", "batch", "reasons"} & set(batch.columns)
    if taken:
        raise ValueError(f"columns in use: {sorted(taken)}")
    marked = add_reasons(batch, rules)
    side = F.when(F.size("reasons") == 0, SIDES[0]).otherwise(SIDES[1])
    rows = marked.withColumns({"side": side, "batch": F.lit(number).cast("long")})
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("side", "batch").parquet(f"{folder}/rows")


def sort_out(
    stream: DataFrame, folder: str, rules: list[Rule] | None = None, once: bool = False
) -> StreamingQuery:
    """Start sorting ``stream`` into the table in ``folder``."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.foreachBatch(lambda batch, number: write_batch(batch, number, folder, rules))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def sorted_rows(spark: SparkSession, folder: str, side: str) -> DataFrame:
    """The ``accepted`` or the ``rejected`` rows so far. Only their files are read."""
    if side not in SIDES:
        raise ValueError(f"unknown side: {side}")
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("side") == side)
    return rows.drop("side", "batch")
