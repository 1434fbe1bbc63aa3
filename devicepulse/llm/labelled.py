"""Bounded labelled samples and the small fits on them, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from devicepulse.llm.shared import small_batches


def remainder(id_col: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def usable(labels: DataFrame, label: str, learn: Column, id_col: str) -> DataFrame:
    """(``id`` as text, ``y``) of the labels 0 and 1 where ``learn`` holds; an id that has
    both labels counts as 0."""
    kept = labels.where(learn).where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    ids = kept.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("y"))
    return ids.groupBy("id").agg(F.min("y").alias("y"))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    *,
    max_rows: int,
    id_col: str,
    text_col: str,
) -> tuple[DataFrame, dict[int, int]]:
    """(``text``, ``y``), the distinct texts of up to ``max_rows`` labels per class, and
    how many labels each class has.

    Taken are the labels with the smallest hash of their id among those where ``learn``
    holds, so the sample is bounded by its parameter and the same in each run. Texts of
    any length are taken whole and stay in the tasks. A text with both labels counts as 0.
    """
    known = usable(labels, label, learn, id_col)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows) for y in (0, 1)]
    # At most 2 * max_rows ids.
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.join(ids, "id").groupBy("text").agg(F.min("y").alias("y")), totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression, by Newton's method with a ridge."""
    coef = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * coef
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        coef += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def squash(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def scored(
    docs: DataFrame, score: Callable[[list[str]], list[float]], id_col: str, text_col: str
) -> DataFrame:
    """(id, ``score``) for every row of ``docs``; ``score`` gets the texts of a batch."""
    small_batches(docs.sparkSession)
    narrow = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([narrow.schema[0]]).add("score", "double")

    def batches(frames):
        for frame in frames:
            values = score(frame["text"].tolist())
            yield pd.DataFrame({id_col: frame[id_col], "score": np.asarray(values, float)})

    return narrow.mapInPandas(batches, schema)
