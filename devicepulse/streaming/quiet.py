"""The last event of each burst, let go by a timer.

A session window closes a burst only once later events of any key have moved the
watermark. Here every key has a timer of its own, so that the last event of a key comes
out when the key has been quiet for a while, with no further input at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_TIMES = (T.TimestampType, T.TimestampNTZType)


def _bursts(names: list[str], order: list[str], gap: int, idle: int):
    """Keeps the last event of each key until a later one or the timer lets it go."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.DataFrame([state.get], columns=names)
            state.remove()
            yield last
            return
        frames = [frame.astype(object) for frame in rows]
        if state.exists:
            frames.insert(0, pd.DataFrame([state.get], columns=names, dtype=object))
        # The rows of one key in one batch, and one more.
        events = pd.concat(frames, ignore_index=True)
        events = events.sort_values(order, kind="stable", ignore_index=True)
        at = events[order[0]].astype("int64")
        state.update(tuple(None if pd.isna(v) else v for v in events.iloc[-1]))
        state.setTimeoutDuration(idle)
        yield events[at.diff().shift(-1) > gap]

    return step


def settled(
    stream: DataFrame,
    key: str,
    ts: str,
    gap: dt.timedelta = dt.timedelta(milliseconds=250),
    idle: dt.timedelta | None = None,
    tiebreak: str | None = None,
) -> DataFrame:
    """Events of ``stream`` after which their key is quiet for longer than ``gap``.

    An event comes out as soon as a later one of its key is more than ``gap`` away, or
    else ``idle`` (``gap``, unless given) after the batch that brought it. An event that
    arrives after its burst was let go starts a new one. Rows without a key or time are
    left out. Columns must be of plain types. A key keeps one event; a task holds one
    key's events of a batch.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream")
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    kinds = {f.name: f.dataType for f in stream.schema if isinstance(f.dataType, _TIMES)}
    plain = rows.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in kinds})
    micro, milli = dt.timedelta(microseconds=1), dt.timedelta(milliseconds=1)
    wait = gap if idle is None else idle
    order = [ts, *([tiebreak] if tiebreak else [])]
    out = plain.groupBy(key).applyInPandasWithState(
        _bursts(plain.columns, order, gap // micro, -(-wait // milli)),
        plain.schema,
        plain.schema,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return out.withColumns({c: F.timestamp_micros(c).cast(kind) for c, kind in kinds.items()})


def until_settled(query: StreamingQuery, poll: float = 0.2) -> None:
    """Wait until the query has taken all input and every key has been let go; stop it."""
    while not query.awaitTermination(poll):
        progress = query.lastProgress
        if progress is None or progress.numInputRows:
            continue
        if all(state.numRowsTotal == 0 for state in progress.stateOperators):
            break
    query.stop()
    if query.exception():
        raise query.exception()
