"""Registered queries against their check SQL, and the entry points."""

import __spark_entry__ as entry_points
import pytest
from pyspark.ml.classification import LogisticRegression

from devicepulse import schema as S
from devicepulse.plans import queries

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


def plain(value):
    return "NULL" if value is None else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_check_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    expected = [dict(zip(names, row)) for row in found.fetchall()]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    theirs = sorted(tuple(plain(row[c]) for c in columns) for row in expected)
    assert ours == theirs


def test_every_query_has_check_sql():
    own = set(QUERIES) - set(entry_points.LLM_QUERIES)
    assert own <= set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 20
    assert {"risk", "advisory", "probability"} <= set(rows[0].asDict())


def test_view_matches_known_totals(spark, sf_dir):
    row = QUERIES["fleet_summary"](spark, sf_dir).first()
    assert (row.total_devices, row.failed_count, row.routers_count) == (1000, 142, 500)
    assert (row.avg_cpu, row.avg_mem, row.avg_temp) == (53.94, 59.94, 56.21)
    counts = {r.advisory: r.n for r in QUERIES["advisory_counts"](spark, sf_dir).collect()}
    assert list(counts.values()) == [154, 136, 221, 54, 679, 41, 509, 82]


def test_fleet_scoring_scores_every_reading(spark, sf_dir):
    df = queries.scored_fleet(spark, sf_dir)
    assert set(S.FEATURES) < set(df.columns)
    rows = df.select("Reading_ID", "probability", "risk", "prediction").collect()
    assert len({r.Reading_ID for r in rows}) == 1000
    assert all(0 <= r.probability <= 1 for r in rows)
    assert all((r.probability > 0.5) == bool(r.prediction) for r in rows)


def test_training_reads_readings_that_are_derived_once(spark, sf_dir, monkeypatch, tmp_path):
    """Training passes over its rows many times and does not derive them each time."""
    given = []

    def stop(train, test, **_):
        given.extend([train, test])
        raise InterruptedError

    monkeypatch.setattr(queries.training, "train_candidates", stop)
    monkeypatch.setattr(queries, "MAX_FIT_ROWS", 19)  # a folder without models
    with pytest.raises(InterruptedError):
        queries.trained(spark, sf_dir)
    train, test = given
    assert train.count() + test.count() == queries.readings(spark, sf_dir).count()
    for side in given:
        assert "event_id" not in side._jdf.queryExecution().optimizedPlan().toString()


def test_training_fits_on_every_row_that_is_not_held_out(spark, monkeypatch, tmp_path):
    events = spark.range(30_000).selectExpr(
        "id AS event_id", "id % 700 AS user_id", "timestamp_seconds(id) AS ts"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    class Counting(LogisticRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    def few(n_train, preset="full", label=S.LABEL):
        return {"Logistic Regression": Counting(labelCol=label, maxIter=5)}

    monkeypatch.setattr(queries.training, "candidates", few)
    test, _, _ = queries.trained(spark, str(tmp_path))
    assert seen == [30_000 - test.count()] == [24_000]
