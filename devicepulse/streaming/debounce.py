"""Keep the last event of each burst, per key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(
    df: DataFrame,
    key: str,
    ts: str,
    gap: dt.timedelta = dt.timedelta(milliseconds=250),
    tiebreak: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Events after which their key is quiet for longer than ``gap``.

    Events exactly one gap apart belong to the same burst. Of events at the same
    time the one with the highest ``tiebreak`` is the last. Rows without a key or
    time are left out. A stream needs a ``watermark`` delay; events later than that
    are dropped, and a burst is emitted once the watermark has passed its end. Times
    without a zone are read in the time zone of the session.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    micros = gap // dt.timedelta(microseconds=1)
    if df.isStreaming:
        if watermark is None:
            raise ValueError("a stream needs a watermark")
        return _stream(rows, key, ts, micros, tiebreak, watermark)
    return _batch(rows, key, ts, micros, tiebreak)


def _stream(df, key, ts, micros, tiebreak, watermark):
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    order = F.struct(ts, tiebreak) if tiebreak else F.col(ts)
    last = F.max_by(F.struct(*df.columns), order)
    sessions = timed.groupBy(key, F.session_window(ts, f"{micros} microseconds"))
    kept = sessions.agg(last.alias("last")).select("last.*")
    return kept.withColumn(ts, F.col(ts).cast(df.schema[ts].dataType))


def _batch(df, key, ts, micros, tiebreak):
    """A key may hold a third of all rows, so its events are split by time slot,
    much longer than the gap. Only the first event of the next slot can matter to
    the last of a slot; its time is added to the slot as a marker row."""
    slot = 32 * max(micros, 1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    events = df.withColumns({"_at": at, "_slot": F.floor(at / slot), "_marker": F.lit(False)})
    firsts = events.groupBy(key, "_slot").agg(F.min("_at").alias("_at"))
    markers = firsts.withColumns({"_slot": F.col("_slot") - 1, "_marker": F.lit(True)})
    order = ["_at", tiebreak] if tiebreak else ["_at"]
    following = F.lead("_at").over(Window.partitionBy(key, "_slot").orderBy(*order))
    both = events.unionByName(markers, allowMissingColumns=True)
    quiet = F.col("_next").isNull() | (F.col("_next") - F.col("_at") > micros)
    return (
        both.withColumn("_next", following)
        .where(~F.col("_marker") & quiet)
        .drop("_at", "_slot", "_marker", "_next")
    )
