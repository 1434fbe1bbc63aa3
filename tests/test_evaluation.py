"""Metrics against brute force, edge cases, model choice."""

import itertools
import random

import pytest

from devicepulse.operators import evaluation as ev
from devicepulse.sources.errors import NoModelChosen

SCHEMA = "model string, label int, prediction int, probability double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for model, noise in (("good", 0.2), ("poor", 2.0)):
        for _ in range(400):
            label = int(rng.random() < 0.3)
            # Rounded, so that there are ties; a third of the rows share one score.
            p = 0.5 if rng.random() < 0.33 else round(rng.gauss(label, noise), 1)
            out.append((model, label, int(p > 0.5), p))
    return out


@pytest.fixture(scope="module")
def predictions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_auc(rows):
    pos = [p for _, y, _, p in rows if y == 1]
    neg = [p for _, y, _, p in rows if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def brute_metrics(rows):
    tp = sum(y == 1 and z == 1 for _, y, z, _ in rows)
    fp = sum(y == 0 and z == 1 for _, y, z, _ in rows)
    fn = sum(y == 1 and z == 0 for _, y, z, _ in rows)
    good = sum(y == z for _, y, z, _ in rows)
    return good / len(rows), tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)


def test_leaderboard_equals_brute_force(rows, predictions, many_slices):
    board = {
        r.model: r
        for r in ev.leaderboard(
            predictions, "model", "label", "prediction", "probability"
        ).collect()
    }
    assert set(board) == {"good", "poor"}
    for model, row in board.items():
        mine = [r for r in rows if r[0] == model]
        expected = (*brute_metrics(mine), brute_auc(mine))
        found = (row.accuracy, row.precision, row.recall, row.f1, row.roc_auc)
        assert found == pytest.approx(expected, abs=1e-12)


def test_auc_by_and_overall(rows, predictions, many_slices):
    by = {
        r.model: r.roc_auc
        for r in ev.roc_auc(predictions, "label", "probability", ["model"]).collect()
    }
    assert by["good"] == pytest.approx(brute_auc([r for r in rows if r[0] == "good"]))
    assert ev.roc_auc(predictions, "label", "probability").first()[0] == pytest.approx(
        brute_auc(rows)
    )


def test_auc_of_the_complement_and_after_repartition(predictions):
    auc = ev.roc_auc(predictions, "label", "probability").first()[0]
    flipped = predictions.selectExpr("label", "1 - probability AS q")
    assert ev.roc_auc(flipped, "label", "q").first()[0] == pytest.approx(1 - auc)
    moved = predictions.repartition(7)
    assert ev.roc_auc(moved, "label", "probability").first()[0] == pytest.approx(auc)


def test_single_class_and_missing_values(spark):
    one = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 1, 0, 0.1)], SCHEMA)
    assert ev.roc_auc(one, "label", "probability").first()[0] is None
    assert ev.leaderboard(one, "model", "label", "prediction", "probability").first().f1 > 0
    gaps = [("m", 1, 1, None), ("m", 0, 1, float("nan")), ("m", None, 1, 0.5), ("m", 1, 1, 0.9), ("m", 0, 0, 0.1)]
    df = spark.createDataFrame(gaps, SCHEMA)
    assert ev.roc_auc(df, "label", "probability").first()[0] == 1.0
    assert tuple(ev.confusion(df, "label", "prediction").first()) == (2, 1, 0, 1)


def test_zero_over_zero_is_zero(spark):
    df = spark.createDataFrame([("m", 0, 0, 0.1), ("m", 0, 0, 0.2)], SCHEMA)
    row = ev.binary_metrics(df, "label", "prediction").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_confusion_sums_to_the_rows(predictions):
    for row in ev.confusion(predictions, "label", "prediction", ["model"]).collect():
        assert row.tp + row.fp + row.fn + row.tn == 400


def test_classification_report(rows, predictions):
    report = {
        r["class"]: r
        for r in ev.classification_report(predictions, "label", "prediction").collect()
    }
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    accuracy, precision, recall, f1 = brute_metrics(rows)
    one = report["1"]
    assert (one.precision, one.recall, one.f1) == pytest.approx((precision, recall, f1))
    assert report["accuracy"].f1 == pytest.approx(accuracy)
    assert report["accuracy"].precision is None
    assert report["0"].support + one.support == len(rows) == report["macro avg"].support
    assert report["macro avg"].recall == pytest.approx((report["0"].recall + one.recall) / 2)
    assert report["weighted avg"].recall == pytest.approx(accuracy)


def test_best_model_first_wins_and_none(spark):
    board = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "model string, f1 double")
    assert ev.best_model_name(board, order=["b", "a", "c"]) == "b"
    assert ev.best_model_name(board, order=["a", "b"]) == "a"
    with pytest.raises(NoModelChosen):
        ev.best_model_name(board.selectExpr("model", "0.0D AS f1"))


@pytest.mark.parametrize(
    "in_use, active",
    [
        ("XGBoost Classifier", {"XGBoost"}),
        ("Gradient Boosted Trees Classifier", {"XGBoost"}),
        ("Random Forest Classifier", {"Random Forest"}),
        ("LOGISTIC regression", {"Logistic Regression"}),
        ("None (Model not trained)", set()),
    ],
)
def test_mark_active(spark, in_use, active):
    names = ["Logistic Regression", "Random Forest", "XGBoost"]
    board = spark.createDataFrame([(n,) for n in names], "model string")
    rows = ev.mark_active(board, in_use).collect()
    assert {r.model for r in rows if r.status == "ACTIVE MODEL"} == active
    assert {r.status for r in rows} <= {"ACTIVE MODEL", "CANDIDATE"}
