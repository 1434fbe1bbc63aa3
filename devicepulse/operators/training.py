"""Candidate classifiers: fit, compare, choose."""

from __future__ import annotations

import functools
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from devicepulse import schema as S
from devicepulse.operators.evaluation import best_model_name, leaderboard
from devicepulse.operators.features import fit_features
from devicepulse.operators.split import balanced_weights
from devicepulse.session import ensure_checkpoint_dir, kept, reread, stored

WEIGHT = "class_weight"
# Training passes over its rows many times; a task takes at least about this many of them.
ROWS_PER_TASK = 10_000
# Hyperparameters of the full preset; ``small`` is for quick runs.
# The forest is of unlimited depth, for which 30 is the most Spark accepts.
PRESETS = {
    "full": {
        "logistic": {"maxIter": 1000},
        "forest": {"numTrees": 200, "maxDepth": 30, "maxMemoryInMB": 1024},
        "boosted": {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05},
    },
    "small": {
        "logistic": {"maxIter": 100},
        "forest": {"numTrees": 50, "maxDepth": 10},
        "boosted": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.2},
    },
}


def candidates(
    n_train: int, preset: str = "full", label: str = S.LABEL, seed: int = 42
) -> dict[str, Estimator]:
    """The three candidates by name, in order of preference on a tie.

    The penalty 1/n_train is an inverse regularisation strength of 1 for a loss
    summed over the rows, where Spark averages it.
    """
    size = PRESETS[preset]
    columns = {"featuresCol": "features", "labelCol": label}
    return {
        "Logistic Regression": LogisticRegression(
            **columns,
            **size["logistic"],
            regParam=1.0 / n_train,
            elasticNetParam=0.0,
            standardization=False,
        ),
        # Without the cache of nodes every task of every level gets all trees so far.
        "Random Forest": RandomForestClassifier(
            **columns, **size["forest"], weightCol=WEIGHT, seed=seed, cacheNodeIds=True
        ),
        "Gradient Boosted Trees": GBTClassifier(
            **columns, **size["boosted"], seed=seed, lossType="logistic"
        ),
    }


def failure_probability(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Replace the probability vector by the probability of class 1."""
    return df.withColumn(probability, vector_to_array(probability)[1])


def train_candidates(
    train: DataFrame,
    test: DataFrame,
    estimators: dict[str, Estimator] | None = None,
    preset: str = "full",
    label: str = S.LABEL,
    max_fit_rows: int | None = None,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every candidate on ``train`` and compare them on all of ``test``.

    ``max_fit_rows`` bounds the labelled rows that the classifiers are fitted on, in
    expectation: a row is taken by a hash of all its columns. Scaling, levels and class
    weights still come from all of ``train``. None takes every row.

    Preprocessing is fitted once, on the training rows, and shared; every returned
    model contains it. The prepared rows are stored, as the forest keeps a node per row by
    its place, cached while the candidates are fitted, spilling to disk, and released
    before returning.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    features = fit_features(train)
    rows = train.count()
    share = min(1.0, max_fit_rows / rows) if max_fit_rows and rows else 1.0
    drawn = F.pmod(F.xxhash64(*train.columns), F.lit(1_000_000)) < round(share * 1_000_000)
    prepared = features.transform(train).select("features", label, drawn.alias("_drawn"))
    prepared = balanced_weights(prepared, label, WEIGHT).where("_drawn").drop("_drawn")
    most = 3 * spark.sparkContext.defaultParallelism
    parts = min(math.ceil(share * rows / ROWS_PER_TASK) or 1, most)
    prepared = stored(prepared.repartition(parts)).persist(StorageLevel.MEMORY_AND_DISK)
    holdout = features.transform(test).select("features", label)
    holdout = holdout.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if estimators is None:
            estimators = candidates(prepared.count(), preset, label)
        fit = inheritable_thread_target(spark)(lambda estimator: estimator.fit(prepared))
        with ThreadPoolExecutor(len(estimators)) as pool:
            fitted = dict(zip(estimators, pool.map(fit, estimators.values())))
        # A task gets all models of its stage: each scores in a job of its own, and what
        # comes after reads the scores and gets none.
        scored = [
            reread(
                failure_probability(m.transform(holdout)).select(
                    F.lit(name).alias("model"), label, "prediction", "probability"
                )
            )
            for name, m in fitted.items()
        ]
        predictions = functools.reduce(DataFrame.unionByName, scored)
        board = leaderboard(predictions, "model", label, "prediction", "probability")
        # One row per candidate: take it before the cache is released.
        board = kept(board)
    finally:
        prepared.unpersist()
        holdout.unpersist()
    models = {name: PipelineModel([*features.stages, m]) for name, m in fitted.items()}
    return models, board


def choose_model(
    models: dict[str, PipelineModel], board: DataFrame, metric: str = "f1"
) -> tuple[str, PipelineModel]:
    """(name, model) of the best candidate, the first fitted on a tie."""
    name = best_model_name(board, metric, list(models))
    return name, models[name]
