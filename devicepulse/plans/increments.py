"""The fleet summary of a growing folder, reading only the files that are new."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicepulse.operators.fleet import merged_summary, summary_parts
from devicepulse.session import names
from devicepulse.sources.requests import NO_MODEL

PART = "part"


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def new_files(spark: SparkSession, source: str, store: str) -> list[str]:
    """The files of ``source`` that ``store`` has no sums of. Files are taken to stay as
    they are once they are there."""
    files = spark.read.parquet(source).inputFiles()
    parts = _stored(spark, store)
    known = {row[0] for row in parts.select(PART).distinct().collect()} if parts else set()
    return sorted(set(files) - known)


def refresh(
    spark: SparkSession,
    source: str,
    store: str,
    by: str | list[str] | None = None,
    active_model: str = NO_MODEL,
) -> DataFrame:
    """The summary of all parquet files at ``source``, whose sums per file and group are
    kept at ``store``.

    Only files without sums are scanned, and their sums are added in one commit. Should
    two runs add the same file, it still counts once. A store serves one ``by``.
    """
    by = names(by)
    fresh = new_files(spark, source, store)
    if fresh:
        rows = spark.read.parquet(*fresh)
        rows = rows.withColumn(PART, F.input_file_name())
        summary_parts(rows, [PART, *by]).write.mode("append").parquet(store)
    parts = _stored(spark, store)
    if parts is None:
        parts = summary_parts(spark.read.parquet(source).withColumn(PART, F.lit("")), [PART, *by])
    return merged_summary(parts.dropDuplicates([PART, *by]), by, active_model)
