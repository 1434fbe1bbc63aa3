"""Streams give what the batch functions give over the same rows."""

import datetime as dt

import pytest

from devicepulse.operators import fleet, scoring, split, training
from devicepulse.plans.readings import readings, table
from devicepulse.streaming import live
from devicepulse.streaming.debounce import debounce

MINUTES = dt.timedelta(minutes=30)


def streamed(spark, df, tmp_path, files=3):
    """``df`` as a stream that arrives file by file."""
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def results(spark, df, tmp_path, name, mode="append"):
    query = live.start(df, str(tmp_path / "checkpoint"), "memory", mode, once=True, queryName=name)
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive
    return spark.table(name)


def test_scoring_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = readings(spark, sf_dir)
    train, test = split.stratified_split(rows, "Reading_ID", "Failed")
    one = {"x": training.candidates(800, "small")["Logistic Regression"]}
    model = training.train_candidates(train, test, one)[0]["x"]
    requests = rows.selectExpr(
        "Reading_ID",
        "CASE WHEN Reading_ID % 9 = 0 THEN '{}' ELSE to_json(struct(*)) END AS request",
    )
    stream = streamed(spark, requests, tmp_path)
    live_rows = results(spark, live.score_stream(stream, model), tmp_path, "scored").collect()
    batch_rows = scoring.score_requests(requests, model).collect()
    assert len(live_rows) == 1000
    assert sorted(map(tuple, live_rows)) == sorted(map(tuple, batch_rows))


def test_summary_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = readings(spark, sf_dir)
    stream = streamed(spark, rows, tmp_path)
    out = results(spark, live.fleet_summary_stream(stream), tmp_path, "summary", "complete")
    assert out.collect() == fleet.fleet_summary(rows).collect()


def test_debounce_stream_equals_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events")
    batch = debounce(events, "user_id", "ts", MINUTES, "event_id")
    expected = {r.event_id for r in batch.collect()}
    stream = streamed(spark, events, tmp_path, files=1)
    out = debounce(stream, "user_id", "ts", MINUTES, "event_id", watermark="1 hour")
    assert out.dtypes == events.dtypes
    found = {r.event_id for r in results(spark, out, tmp_path, "bursts").collect()}
    # Bursts that end within the watermark delay are still open.
    last = max(r.ts for r in events.select("ts").collect())
    late = {r.event_id for r in events.collect() if r.ts > last - MINUTES - dt.timedelta(hours=1)}
    assert found <= expected and expected - found <= late


def brute_debounce(rows, gap):
    kept = []
    for key in {k for k, *_ in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        for here, following in zip(mine, [*mine[1:], None]):
            if following is None or following[0] - here[0] > gap:
                kept.append(here[1])
    return sorted(kept)


def test_debounce_against_brute_force_with_a_hot_key(spark):
    start = dt.datetime(2024, 1, 1)
    # Key 0 has most events; some are equal in time, some exactly one gap apart.
    seconds = [(i * i * 7) % 5000 for i in range(300)]
    rows = [
        (0 if i % 3 else i % 5, start + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)
    ]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, id int")
    for gap in (0, 1, 5, 20, 500):
        step = dt.timedelta(seconds=gap)
        found = [r.id for r in debounce(df, "k", "t", step, "id").collect()]
        assert sorted(found) == brute_debounce(rows, step)


def test_exactly_one_gap_apart_is_one_burst(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = [0, 250, 500, 751, 5000]
    rows = [("a", start + dt.timedelta(milliseconds=ms), i) for i, ms in enumerate(at)]
    # A later key moves the watermark past the bursts.
    rows.append(("z", start + dt.timedelta(hours=5), 99))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int")
    batch = {r.id for r in debounce(df, "k", "t", tiebreak="id").collect()}
    assert batch == {2, 3, 4, 99}
    stream = streamed(spark, df, tmp_path, files=1)
    out = debounce(stream, "k", "t", tiebreak="id", watermark="1 second")
    assert {r.id for r in results(spark, out, tmp_path, "gaps").collect()} == {2, 3, 4}


def test_wrong_kind_of_input(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "k int, t timestamp_ntz")
    with pytest.raises(ValueError):
        live.fleet_summary_stream(df)
    with pytest.raises(ValueError):
        debounce(streamed(spark, df, tmp_path, 1), "k", "t")
