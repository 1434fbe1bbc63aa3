"""Candidates, comparison, saving and scoring."""

import json

import pytest
from pyspark.ml.classification import LogisticRegression

from devicepulse import schema as S
from devicepulse.operators import evaluation, scoring, split, training
from devicepulse.plans import batch_job
from devicepulse.plans.readings import readings
from devicepulse.sources import models, telemetry


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    return split.stratified_split(readings(spark, sf_dir), "Reading_ID", "Failed")


@pytest.fixture(scope="module")
def trained(sides):
    return training.train_candidates(*sides, preset="small")


def test_full_preset_values(spark):
    full = training.candidates(8000)
    assert list(full) == ["Logistic Regression", "Random Forest", "Gradient Boosted Trees"]
    logistic, forest, boosted = full.values()
    assert logistic.getMaxIter() == 1000 and logistic.getRegParam() == 1 / 8000
    assert not logistic.getStandardization() and logistic.getElasticNetParam() == 0
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (200, 30, 42)
    assert forest.getWeightCol() == training.WEIGHT
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (200, 5, 0.05)


def test_candidates_reach_the_floors(trained):
    models_, board = trained
    rows = {r.model: r for r in board.collect()}
    assert set(rows) == set(models_)
    for row in rows.values():
        assert row.roc_auc > 0.85 and row.accuracy > 0.85 and row.f1 > 0.4
    name, model = training.choose_model(models_, board)
    assert rows[name].f1 == max(r.f1 for r in rows.values())
    assert len(model.stages) == 6


def test_saved_model_scores_the_same(spark, sides, trained, tmp_path):
    models_, _ = trained
    path = str(tmp_path / "model")
    titles = {
        "Logistic Regression": "Logistic Regression",
        "Random Forest": "Random Forest Classifier",
        "Gradient Boosted Trees": "Gradient Boosted Trees Classifier",
    }
    for name, model in models_.items():
        models.save_model(model, path)
        loaded = models.load_model(path)
        assert models.active_model_name(loaded) == titles[name]
        before = scoring.score_fleet(sides[1], model).orderBy("Reading_ID").collect()
        after = scoring.score_fleet(sides[1], loaded).orderBy("Reading_ID").collect()
        assert before == after
        assert {r.model_used for r in before} == {titles[name]}


def test_leaderboard_equals_metrics_of_the_scored_rows(sides, trained):
    models_, board = trained
    for row in board.collect():
        scored = scoring.score_fleet(sides[1], models_[row.model])
        again = evaluation.binary_metrics(scored, "Failed", "prediction").first()
        assert (row.accuracy, row.f1) == pytest.approx((again.accuracy, again.f1))
        auc = evaluation.roc_auc(scored, "Failed", "probability").first()[0]
        assert row.roc_auc == pytest.approx(auc)


def test_scenarios_are_ranked_sensibly(spark, trained):
    models_, _ = trained
    scored = scoring.score_fleet(telemetry.scenarios(spark), models_["Logistic Regression"])
    rows = {r.scenario: r for r in scored.collect()}
    assert rows["critical-failure"].risk == "HIGH" and rows["cli_demo"].risk == "HIGH"
    assert rows["healthy-router"].risk == "LOW" and rows["healthy-switch"].risk == "LOW"
    assert len(rows["critical-failure"].advisory) == 7


def test_requests_get_the_score_of_the_fleet_path(spark, trained):
    model = trained[0]["Logistic Regression"]
    demo = dict(zip(S.FEATURES, S.SCENARIO_ROWS[0][1:]))
    texts = [json.dumps(demo), "{}", '{"CPU_Usage": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, request string")
    answers = {r.id: json.loads(r.response) for r in
               scoring.score_requests(df, model).collect()}
    expected = scoring.score_fleet(telemetry.device_rows(spark, [demo]), model).first()
    assert answers[0]["probability"] == pytest.approx(expected.probability)
    assert answers[0]["risk"] == expected.risk and answers[0]["success"] is True
    assert answers[1] == {"error": "empty_request"}
    assert answers[2] == {"error": "not_a_number:CPU_Usage"}


def test_batch_job(spark, sf_dir, tmp_path):
    df = readings(spark, sf_dir).where("Reading_ID < 400").selectExpr(
        "concat('DEV-', Reading_ID) AS Device_ID", *S.TELEMETRY.fieldNames()[1:]
    )
    source, out = str(tmp_path / "csv"), str(tmp_path / "out")
    bad = df.limit(1).selectExpr(
        "'DEV-bad' AS Device_ID", "Device_Type", "CPU_Usage + 100 AS CPU_Usage",
        *S.TELEMETRY.fieldNames()[3:],
    )
    telemetry.write_telemetry(df.union(bad), source, "csv")
    tables = batch_job.run(
        spark, source, str(tmp_path / "model"), preset="small", output=out
    )
    assert tables["rejected"].first().reasons == ["out_of_range:CPU_Usage"]
    assert tables["scored"].count() == 400
    assert tables["scenarios"].count() == len(S.SCENARIO_ROWS)
    assert tables["fleet_summary"].first().total_devices == 401
    statuses = [r.status for r in tables["leaderboard"].collect()]
    assert sorted(statuses) == ["ACTIVE MODEL", "CANDIDATE", "CANDIDATE"]
    stored = spark.read.parquet(f"{out}/boxes")
    assert stored.count() == 6
    assert isinstance(training.candidates(1)["Logistic Regression"], LogisticRegression)
