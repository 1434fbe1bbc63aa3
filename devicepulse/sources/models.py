"""Saving, loading and naming fitted models."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from devicepulse.session import local_table
from devicepulse.sources.errors import ModelNotFound
from devicepulse.sources.requests import NO_MODEL

# Below the folder of a model: the names of its published versions.
PUBLISHED = "published"


def save_model(model: PipelineModel, path: str) -> None:
    """Save preprocessing and classifier together, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a saved model; ``ModelNotFound`` when there is none."""
    try:
        return PipelineModel.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ModelNotFound(f"no trained model at {path}") from error
        raise


def publish_model(model: PipelineModel, folder: str) -> str:
    """Save ``model`` as a new version below ``folder`` and make it the current one.

    The version is complete before its name is added to the list of published versions,
    in one commit. So whoever loads meanwhile gets the version before, and a save that
    fails changes nothing.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{folder}/{version}")
    spark = SparkSession.active()
    published = local_table(spark, [(version,)], StructType().add("value", "string"))
    published.coalesce(1).write.mode("append").text(f"{folder}/{PUBLISHED}")
    return version


def current_version(spark: SparkSession, folder: str) -> str:
    """Name of the version published last; ``ModelNotFound`` when there is none."""
    try:
        found = spark.read.text(f"{folder}/{PUBLISHED}").agg(F.max("value")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        raise ModelNotFound(f"no published model at {folder}")
    return found


def load_current(spark: SparkSession, folder: str) -> PipelineModel:
    """The version published last."""
    return load_model(f"{folder}/{current_version(spark, folder)}")


def active_model_name(model: PipelineModel | None) -> str:
    """Display name of the classifier in use."""
    if model is None:
        return NO_MODEL
    classifier = model.stages[-1] if isinstance(model, PipelineModel) else model
    names = {
        LogisticRegressionModel: "Logistic Regression",
        RandomForestClassificationModel: "Random Forest Classifier",
        GBTClassificationModel: "Gradient Boosted Trees Classifier",
    }
    return names.get(type(classifier), type(classifier).__name__)
