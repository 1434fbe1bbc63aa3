"""Streams into tables that survive failures, timers, growing folders and model versions."""

import datetime as dt
import threading
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.operators import fleet, scoring, split, training
from devicepulse.plans import increments
from devicepulse.plans.queries import _columns
from devicepulse.plans.readings import DIRTY, readings
from devicepulse.sources import models
from devicepulse.sources.errors import ModelNotFound
from devicepulse.streaming import live, quarantine, quiet


def arrive(df, folder, files=1):
    df.repartition(files).write.mode("append").parquet(folder)


def stream_of(spark, df, folder, **options):
    return live.arriving(spark, folder, df.schema, maxFilesPerTrigger="1", **options)


def test_scored_table_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    rows = readings(spark, sf_dir).selectExpr("Reading_ID", "to_json(struct(*)) AS request")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        arrive(rows.where(F.col("Reading_ID") % 3 == part), source, 2)
        stream = live.score_stream(stream_of(spark, rows, source), None, scorer=scoring.score_by_rule)
        out = live.catch_up(stream, sink)
        assert out.count() == rows.where(F.col("Reading_ID") % 3 <= part).count()
    batch = scoring.score_requests(rows, None, scorer=scoring.score_by_rule)
    assert sorted(out.collect()) == sorted(batch.collect())


def test_replayed_batch_leaves_each_row_once(spark, sf_dir, tmp_path):
    dirty = readings(spark, sf_dir).selectExpr("Reading_ID", *_columns(DIRTY))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(dirty, source, 3)
    stream = stream_of(spark, dirty, source)
    written = []

    def fails_once(batch, number):
        quarantine.write_batch(batch, number, folder)
        written.append(number)
        if written == [0, 1]:
            raise RuntimeError("lost after the write, before the commit")

    failing = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    query = failing.trigger(availableNow=True).foreachBatch(fails_once).start()
    with pytest.raises(Exception, match="before the commit"):
        query.awaitTermination()
    quarantine.sort_out(stream, folder, once=True).awaitTermination()
    sides = {s: quarantine.sorted_rows(spark, folder, s).collect() for s in quarantine.SIDES}
    ids = {s: [r.Reading_ID for r in rows] for s, rows in sides.items()}
    assert sorted(ids["accepted"] + ids["rejected"]) == sorted(r.Reading_ID for r in dirty.collect())
    assert len(ids["rejected"]) > 100 and all(r.reasons for r in sides["rejected"])
    assert not any(r.reasons for r in sides["accepted"])


def test_quarantine_refuses_columns_in_use(spark, tmp_path):
    with pytest.raises(ValueError):
        quarantine.write_batch(spark.range(1).withColumn("side", F.lit(1)), 0, str(tmp_path))


def test_idle_key_is_let_go_without_further_input(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    first = [("a", 0, 1), ("a", 200, 2), ("a", 900, 3), ("b", 100, 4), (None, 5, 5)]
    rows = [(k, start + dt.timedelta(milliseconds=ms), i) for k, ms, i in first]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(df, source)
    last = quiet.settled(stream_of(spark, df, source), "k", "t", tiebreak="id")
    assert last.dtypes == df.dtypes
    query = live.start(last, f"{sink}/checkpoint", "parquet", path=f"{sink}/rows")
    ids = lambda: sorted(r.id for r in spark.read.schema(df.schema).parquet(f"{sink}/rows").collect())
    deadline = time.time() + 90
    while time.time() < deadline and (not (tmp_path / "out/rows").exists() or ids() != [2, 3, 4]):
        time.sleep(0.2)
    assert ids() == [2, 3, 4] and query.isActive
    # The same key again: a burst of its own.
    arrive(spark.createDataFrame([("b", start + dt.timedelta(seconds=9), 6)], df.schema), source)
    while time.time() < deadline and ids() != [2, 3, 4, 6]:
        time.sleep(0.2)
    quiet.until_settled(query)
    assert ids() == [2, 3, 4, 6] and not query.isActive


def test_summary_of_a_growing_folder(spark, sf_dir, tmp_path, monkeypatch):
    rows = readings(spark, sf_dir).select(*S.FEATURES, S.LABEL, "Reading_ID")
    rows = rows.withColumn("CPU_Usage", F.when(F.col("Reading_ID") % 7 == 0, float("nan")).otherwise(F.col("CPU_Usage")))
    source, scanned = str(tmp_path / "in"), []
    parts = fleet.summary_parts
    monkeypatch.setattr(
        increments, "summary_parts", lambda df, by: scanned.append(len(df.inputFiles())) or parts(df, by)
    )
    for by in (None, "Device_Type"):
        store = str(tmp_path / f"sums-{by}")
        for share in range(3):
            if by is None:
                arrive(rows.where(F.col("Reading_ID") % 3 == share), source, 2)
            found = increments.refresh(spark, source, store, by)
            so_far = spark.read.parquet(source)
            assert sorted(found.collect()) == sorted(fleet.fleet_summary(so_far, by).collect())
    # Two files at a time, then all six at once, then none.
    assert scanned == [2, 2, 2, 6]
    assert increments.new_files(spark, source, store) == []


def small_model(spark, sf_dir, label=S.LABEL):
    train, test = split.stratified_split(readings(spark, sf_dir), "Reading_ID", "Failed")
    one = {"x": training.candidates(800, "small")["Logistic Regression"]}
    return training.train_candidates(train, test, one)[0]["x"]


def test_loading_while_versions_are_published(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "models")
    with pytest.raises(ModelNotFound):
        models.load_current(spark, folder)
    model = small_model(spark, sf_dir)
    names = [models.publish_model(model, folder)]
    publisher = threading.Thread(
        target=lambda: names.extend(models.publish_model(model, folder) for _ in range(4))
    )
    publisher.start()
    loads = 0
    while publisher.is_alive() or not loads:
        assert isinstance(models.load_current(spark, folder), PipelineModel)
        loads += 1
    publisher.join()
    assert models.current_version(spark, folder) == names[-1] and len(names) == 5
    # A save that breaks off is never seen.
    model.write().save(f"{folder}/99999999999999999999-broken")
    assert models.current_version(spark, folder) == names[-1]


def test_new_version_is_used_from_the_next_batch(spark, sf_dir, tmp_path):
    rows = readings(spark, sf_dir).limit(60).selectExpr("Reading_ID", "to_json(struct(*)) AS request")
    folder, source, sink = (str(tmp_path / name) for name in ("models", "in", "out"))
    model = small_model(spark, sf_dir)
    versions = [None]
    for share in range(3):
        arrive(rows.where(F.col("Reading_ID") % 3 == share), source)
        live.score_with_current(stream_of(spark, rows, source), folder, sink, once=True).awaitTermination()
        versions.append(models.publish_model(model, folder))
    out = spark.read.parquet(f"{sink}/rows")
    used = {(r.batch, r.model_version) for r in out.select("batch", "model_version").collect()}
    assert used == {(i, versions[i]) for i in range(3)}
    assert out.count() == 60
    errors = out.where(F.col("response").contains("no model loaded"))
    assert {r.batch for r in errors.collect()} == {0}
