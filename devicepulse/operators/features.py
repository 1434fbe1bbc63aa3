"""Scaling, one-hot encoding and the Spark ML feature stages."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse import schema as S
from devicepulse.functions.rules import known


def select_features(
    df: DataFrame, cols: list[str] = S.FEATURES, label: str | None = S.LABEL
) -> DataFrame:
    """The feature columns in order, then the label."""
    return df.select(*cols, *([label] if label else []))


def standardize(
    df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, prefix: str = "z_"
) -> DataFrame:
    """Add ``(x - mean) / population deviation`` per column, fitted on ``fit_on``.

    A column without spread is only centred. The statistics are one row, so they
    enter the plan as constants and the data needs no join.
    """
    source = df if fit_on is None else fit_on
    stats = source.agg(
        *[F.avg(known(F.col(c))).alias(f"mean_{c}") for c in cols],
        *[F.stddev_pop(known(F.col(c))).alias(f"std_{c}") for c in cols],
    ).first()
    return df.withColumns(
        {
            prefix + c: (known(F.col(c)) - F.lit(stats[f"mean_{c}"]))
            / F.lit(stats[f"std_{c}"] or 1.0)
            for c in cols
        }
    )


def one_hot(
    df: DataFrame,
    col: str,
    drop: str | None = "first",
    fit_on: DataFrame | None = None,
    max_levels: int = 10_000,
) -> DataFrame:
    """Add a 0/1 column per level of ``col`` but the first in alphabetical order
    (``drop=None`` keeps it). A value that was not fitted, NULL too, is an error.

    Each level is a column. More than ``max_levels`` are refused, and no more than that
    reach the driver: ``feature_stages`` makes one sparse vector of any number.
    """
    source = df if fit_on is None else fit_on
    found = source.where(F.col(col).isNotNull()).select(col).distinct()
    levels = sorted(row[0] for row in found.limit(max_levels + 1).collect())
    if len(levels) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels: use feature_stages")
    fitted = F.coalesce(F.col(col).isin(levels), F.lit(False))
    shown = F.coalesce(F.col(col).cast("string"), F.lit("NULL"))
    message = F.concat(F.lit(f"unknown {col}: "), shown)
    kept = levels[1:] if drop == "first" else levels
    wrong = F.raise_error(message).cast(df.schema[col].dataType)
    # The column itself is checked, so that one fitted level refuses others as well.
    checked = df.withColumn(col, F.when(fitted, F.col(col)).otherwise(wrong))
    return checked.withColumns(
        {f"{col}_{level}": (F.col(col) == F.lit(level)).cast("int") for level in kept}
    )


def feature_stages(
    numeric: list[str] = S.NUMERIC_FEATURES,
    categorical: list[str] = S.CATEGORICAL_FEATURES,
    one_level: list[str] = (),
) -> list:
    """Spark ML stages for a ``features`` vector: scaled numbers, then indicators.

    The scaler divides by the sample deviation, ``standardize`` by the population
    one; with n rows they differ by sqrt(n / (n - 1)). Missing values and unknown
    levels are errors: set such rows aside with ``validate`` first. A column of
    ``one_level`` has a single level; it stays as its index, which is 0, because the
    encoder needs two levels and an unused index would not refuse unknown ones.
    """
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="_numbers", handleInvalid="error"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]
    for c in categorical:
        # Descending order makes the first level the last index, the one dropped.
        stages += [
            StringIndexer(
                inputCol=c,
                outputCol=f"_{c}_index",
                stringOrderType="alphabetDesc",
                handleInvalid="error",
            )
        ]
        if c not in one_level:
            stages.append(
                OneHotEncoder(inputCol=f"_{c}_index", outputCol=f"_{c}_flags", dropLast=True)
            )
    flags = [f"_{c}_{'index' if c in one_level else 'flags'}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=["_scaled", *flags], outputCol="features")]


def fit_features(
    train: DataFrame,
    numeric: list[str] = S.NUMERIC_FEATURES,
    categorical: list[str] = S.CATEGORICAL_FEATURES,
) -> PipelineModel:
    """Fit the feature stages on training rows only."""
    ends = train.agg(*[(F.min(c) == F.max(c)).alias(c) for c in categorical]).first()
    one_level = [c for c in categorical if ends[c]]
    return Pipeline(stages=feature_stages(numeric, categorical, one_level)).fit(train)


def linear_score(cols: list[str], coefs: list[float], intercept: float) -> Column:
    """Logistic probability of a linear model with the given coefficients."""
    total = F.lit(float(intercept))
    for c, weight in zip(cols, coefs, strict=True):
        total = total + F.lit(float(weight)) * F.col(c)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def linear_probability(model: PipelineModel) -> Column:
    """The failure probability of a fitted linear model as one expression of the input
    columns, with scaling and levels folded into the coefficients.

    It runs where any expression does, in SQL text too, without the ML stages. A missing
    reading or unknown level, which the stages refuse, gives NULL.
    """
    classifier = model.stages[-1]
    if not isinstance(classifier, LogisticRegressionModel):
        raise ValueError("not a linear model")
    stages = {kind: [s for s in model.stages if isinstance(s, kind)] for kind in (
        VectorAssembler, StandardScalerModel, StringIndexerModel, OneHotEncoderModel,
    )}
    numbers = stages[VectorAssembler][0].getInputCols()
    (scaler,) = stages[StandardScalerModel]
    weights = iter(classifier.coefficients.toArray().tolist())
    total = F.lit(float(classifier.intercept))
    for c, mean, std in zip(numbers, scaler.mean, scaler.std):
        weight = next(weights) / std if std else 0.0 * next(weights)
        total = total + (known(F.col(c)) - F.lit(float(mean))) * F.lit(weight)
    encoded = {encoder.getInputCol() for encoder in stages[OneHotEncoderModel]}
    for indexer in stages[StringIndexerModel]:
        levels = indexer.labels
        # The last level has no flag; one that is alone stays as its index, 0.
        flagged = levels[:-1] if indexer.getOutputCol() in encoded else levels
        given = F.col(indexer.getInputCol())
        term = F.when(given.isin(levels), F.lit(0.0))
        for i, level in enumerate(flagged):
            weight = next(weights) * (1.0 if indexer.getOutputCol() in encoded else i)
            term = F.when(given == level, F.lit(weight)).otherwise(term)
        total = total + term
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
