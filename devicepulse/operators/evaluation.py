"""Binary classification metrics, per-class report and model choice.

Rows with a NULL label are not evaluated; a missing prediction counts as the wrong one of
the two classes in every metric. Counts are combined before the shuffle; for the ROC-AUC
there is one row per distinct score, which is shuffled and stored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse.functions.rules import known
from devicepulse.operators.ranks import running_totals
from devicepulse.session import kept, names
from devicepulse.sources.errors import NoModelChosen

CELLS = ["tp", "fp", "fn", "tn"]
METRICS = ["accuracy", "precision", "recall", "f1"]
# Words that tell the model families apart, in order of precedence.
FAMILIES = [("xgb", "boost"), ("random",), ("logistic",)]


def _cell_counts(label: str, pred: str) -> list[Column]:
    actual = F.col(label) == 1
    # A missing prediction is an error of its class.
    predicted = F.when(known(F.col(pred)).isNull(), ~actual).otherwise(F.col(pred) == 1)
    hits = [actual & predicted, ~actual & predicted, actual & ~predicted, ~actual & ~predicted]
    return [F.count_if(hit).alias(name) for name, hit in zip(CELLS, hits)]


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _metrics() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    return [
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def confusion(
    df: DataFrame, label: str, pred: str, by: str | list[str] | None = None
) -> DataFrame:
    """Counts ``tp``, ``fp``, ``fn`` and ``tn`` of class 1."""
    return df.groupBy(*names(by)).agg(*_cell_counts(label, pred))


def binary_metrics(
    df: DataFrame, label: str, pred: str, by: str | list[str] | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a ratio is 0/0."""
    return confusion(df, label, pred, by).select(*names(by), *_metrics())


def _area() -> Column:
    """ROC-AUC from counts per distinct score: the share of (positive, negative)
    pairs in the right order, a tie being half. NULL with a single class."""
    won = F.col("pos") * (F.col("neg_before").cast("double") + F.col("neg") / 2)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return F.try_divide(F.sum(won), pairs)


def _ranked(df: DataFrame, by: list[str], label: str, score: str, *extra: Column) -> DataFrame:
    """Positives and negatives per distinct score, with running totals. A missing
    score counts as neither."""
    scored = known(F.col(score)).isNotNull()
    counts = df.groupBy(*by, score).agg(
        F.count_if(scored & (F.col(label) == 1)).alias("pos"),
        F.count_if(scored & (F.col(label) != 1)).alias("neg"),
        *extra,
    )
    return running_totals(counts, by, [score], ["pos", "neg"])


def roc_auc(df: DataFrame, label: str, score: str, by: str | list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, from the scores rather than the classes."""
    ranked = _ranked(df, names(by), label, score)
    return ranked.groupBy(*names(by)).agg(_area().alias("roc_auc"))


def leaderboard(df: DataFrame, model: str, label: str, pred: str, score: str) -> DataFrame:
    """One row per model with accuracy, precision, recall, F1 and ROC-AUC, from one
    pass over the predictions. Rows without a score do not enter the ROC-AUC."""
    ranked = _ranked(df, [model], label, score, *_cell_counts(label, pred))
    totals = ranked.groupBy(model).agg(
        *[F.sum(c).alias(c) for c in CELLS], _area().alias("roc_auc")
    )
    return totals.select(model, *_metrics(), "roc_auc")


def classification_report(
    df: DataFrame, label: str, pred: str, by: str | list[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, followed by the accuracy (in
    ``f1``, with no precision or recall) and the macro and weighted averages; one such
    report per group of ``by``."""
    by = names(by)
    y = F.col(label).cast("int")
    wrong = F.when(y.isin(0, 1), 1 - y)
    z = F.coalesce(known(F.col(pred)).cast("int"), wrong)
    counts = df.groupBy(*by, y.alias("y"), z.alias("z")).agg(F.count(label).alias("n"))
    # From here on one row per (label, prediction) pair, used for two results.
    pairs = kept(counts).where("n > 0")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.lit(1).alias("real"), F.lit(0).alias("said")),
        F.struct(F.col("z").alias("class"), F.lit(0).alias("real"), F.lit(1).alias("said")),
    )
    right = F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)
    per_class = (
        pairs.select(*by, F.explode(sides).alias("side"), "n", right.alias("right"))
        .where("side.class IS NOT NULL")
        .groupBy(*by, "side.class")
        .agg(
            F.sum(F.col("right") * F.col("side.real")).alias("hit"),
            F.sum(F.col("n") * F.col("side.real")).alias("support"),
            F.sum(F.col("n") * F.col("side.said")).alias("claimed"),
        )
    )
    hit, support, claimed = F.col("hit"), F.col("support"), F.col("claimed")
    scores = ["precision", "recall", "f1"]
    rows = per_class.select(
        *by,
        F.col("class").cast("string").alias("class"),
        _ratio(hit, claimed).alias("precision"),
        _ratio(hit, support).alias("recall"),
        _ratio(2 * hit, support + claimed).alias("f1"),
        "support",
        "hit",
    )
    none = F.lit(None).cast("double")
    averages = rows.groupBy(*by).agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                none.alias("precision"),
                none.alias("recall"),
                F.try_divide(F.sum("hit"), F.sum("support")).alias("f1"),
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(c).alias(c) for c in scores],
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[
                    F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
                    for c in scores
                ],
                F.sum("support").alias("support"),
            ),
        ).alias("averages")
    )
    return rows.drop("hit").unionByName(averages.select(*by, F.inline("averages")))


def best_model(board: DataFrame, metric: str = "f1", order: list[str] = ()) -> DataFrame:
    """The row with the highest metric, the first in ``order`` on a tie (then by
    name); no row if none is above zero."""
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col("model") == name, F.lit(i)).otherwise(place)
    placed = board.where(F.col(metric) > 0).withColumn("_place", place)
    return placed.orderBy(F.desc(metric), "_place", "model").limit(1).drop("_place")


def best_model_name(board: DataFrame, metric: str = "f1", order: list[str] = ()) -> str:
    """Name of the best model; ``NoModelChosen`` if none is above zero."""
    row = best_model(board, metric, order).first()
    if row is None:
        raise NoModelChosen(f"no candidate has {metric} above zero")
    return row["model"]


def mark_active(board: DataFrame, name: str) -> DataFrame:
    """Add ``status``: ACTIVE MODEL for the family of the model in use, else CANDIDATE."""
    in_use = next((f for f in FAMILIES if any(word in name.lower() for word in f)), ())
    hits = [F.lower("model").contains(word) for word in in_use]
    active = functools.reduce(lambda a, b: a | b, hits, F.lit(False))
    return board.withColumn("status", F.when(active, "ACTIVE MODEL").otherwise("CANDIDATE"))

