"""Request scoring and the fleet summary over streams.

Both are the batch functions: the same plan runs over a table and a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from devicepulse.operators.fleet import fleet_summary
from devicepulse.operators.scoring import score_requests
from devicepulse.sources.errors import ModelNotFound
from devicepulse.sources.models import current_version, load_model
from devicepulse.sources.requests import NO_MODEL


def _need_stream(df: DataFrame) -> DataFrame:
    if not df.isStreaming:
        raise ValueError("not a stream")
    return df


def score_stream(
    stream: DataFrame,
    model: PipelineModel | None,
    col: str = "request",
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add a JSON ``response`` to a stream of JSON requests; keeps no state."""
    return score_requests(_need_stream(stream), model, col, scorer)


def fleet_summary_stream(
    stream: DataFrame, by: str | list[str] | None = None, active_model: str = NO_MODEL
) -> DataFrame:
    """Running fleet summary, to be written in complete (or update) mode. The state
    is one row of sums and counts per group."""
    return fleet_summary(_need_stream(stream), by, active_model)


def start(
    df: DataFrame,
    checkpoint: str,
    fmt: str,
    mode: str = "append",
    once: bool = False,
    **options: str,
) -> StreamingQuery:
    """Start writing a stream; with ``once`` it stops when the input is used up."""
    writer = df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if "queryName" in options:
        writer = writer.queryName(options.pop("queryName"))
    return writer.options(**options).start()


def arriving(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """The parquet files in the folder ``path``, or that match a pattern, as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def catch_up(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Bring the table in ``folder`` up to date with all that has arrived, and read it.

    The file sink notes which files a batch has added, and the checkpoint lies beside
    them, so a run that fails is taken up where it stopped and no row comes twice. A
    later call goes on with what has arrived since.
    """
    start(
        _need_stream(df), f"{folder}/checkpoint", "parquet", mode, once=True, path=f"{folder}/rows"
    ).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def score_with_current(
    stream: DataFrame, models: str, folder: str, col: str = "request", once: bool = False
) -> StreamingQuery:
    """Score a stream with the model that is current below ``models`` as each batch starts.

    A version published meanwhile is used from the next batch on; without any, requests
    are answered with an error. The rows of a batch, with their ``model_version``, are a
    partition of ``folder``/rows that a replay replaces, so none comes twice.
    """
    held: dict[str, PipelineModel] = {}

    def write(batch: DataFrame, number: int) -> None:
        try:
            version = current_version(batch.sparkSession, models)
        except ModelNotFound:
            version = None
        if version is not None and version not in held:
            held.clear()
            held[version] = load_model(f"{models}/{version}")
        scored = score_requests(batch, held.get(version), col)
        named = scored.withColumns(
            {"model_version": F.lit(version).cast("string"), "batch": F.lit(number).cast("long")}
        )
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(f"{folder}/rows")

    writer = _need_stream(stream).writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()
