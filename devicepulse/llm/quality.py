"""Quality by a Bradley-Terry ranking of document pairs.

Each document is described by how its bytes, words, lines and sentences are made up. In
a preference pair a good document is preferred to a bad one; the weights minimise the
logistic loss of the differences of their features. The threshold is the quantile of
the learned values of all documents to learn from that leaves the labelled share of good
ones above it, and the score is placed so that this threshold is at ``CUT``.

Results that are defined for odd input: NULL and empty text has the features 0; a very
long text is read whole; repeated rows get equal scores; without labels of both classes
every score is the share of good labels, one half without any; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicepulse.llm.labelled import logistic, remainder, sample, scored, squash, usable
from devicepulse.llm.shared import small_batches
from devicepulse.llm.words import WordHasher

CUT = 0.7
SENTENCE = re.compile(r"[.!?\n]+")
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def _repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts)


def features(texts: list[str]) -> np.ndarray:
    """One row per text."""
    rows = []
    for text, words in zip(texts, WordHasher().each(texts)):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = np.bincount(raw, minlength=256)
        size = max(len(raw), 1)
        shares = [n[65:91].sum(), n[48:58].sum(), n[128:].sum(), n[10], n[32], n[:9].sum()]
        shares = np.sqrt(np.array([*shares, *n[MARKS]]) / size)
        sentences = [s.strip() for s in SENTENCE.split(text)]
        count = max(len(words), 1)
        others = [
            np.log1p(len(words)),
            np.log1p(len(words)) ** 2 / 10,
            np.log1p(size / count),
            len(np.unique(words)) / count,
            _repeated(text.split("\n")),
            _repeated(sentences),
            np.log1p(count / len(sentences)),
        ]
        rows.append(np.concatenate([shares, others]))
    return np.array(rows, float).reshape(len(texts), len(MARKS) + 13)


@dataclass
class QualityModel:
    """Weights of standardised features and the threshold; without weights a constant."""

    constant: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    threshold: float = 0.0

    def worth(self, texts: list[str]) -> np.ndarray:
        """The Bradley-Terry value: the log odds of a preference are its differences."""
        return ((features(texts) - self.mean) / self.scale) @ self.weights

    def score(self, texts: list[str]) -> list[float]:
        """From 0 to 1, higher for good texts; ``CUT`` at the threshold."""
        if self.weights is None:
            return [self.constant] * len(texts)
        if not texts:
            return []
        lift = np.log(CUT / (1 - CUT)) - self.threshold
        return [squash(v) for v in self.worth(texts) + lift]


def fit(
    x: np.ndarray, y: np.ndarray, constant: float, pairs: int = 60_000, ridge: float = 20.0
) -> QualityModel:
    """A model, still without its threshold, from the ``features`` of documents and their
    labels. ``pairs`` preference pairs are drawn with a fixed seed."""
    if set(y.tolist()) != {0, 1}:
        return QualityModel(constant)
    model = QualityModel(constant, x.mean(0), x.std(0) + 1e-6)
    x = (x - model.mean) / model.scale
    draw = np.random.default_rng(10)
    good = draw.choice(np.flatnonzero(y == 1), pairs)
    bad = draw.choice(np.flatnonzero(y == 0), pairs)
    model.weights = logistic(x[good] - x[bad], np.ones(pairs), np.ones(pairs), ridge)
    return model


def _described(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of a bounded sample; no text leaves the tasks."""

    def batches(frames):
        for frame in frames:
            rows = features(frame["text"].tolist()).tolist()
            yield pd.DataFrame({"key": frame["key"], "y": frame["y"], "x": rows})

    keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("key"), "y", "text")
    rows = keyed.mapInPandas(batches, "key string, y int, x array<double>").toPandas()
    rows = rows.sort_values("key")
    return np.array(rows["x"].tolist(), float), rows["y"].to_numpy(int)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 4_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Weights from at most ``max_rows`` labelled documents per class, and the threshold
    from the values of all labelled documents, up to 1e-5 of their ranks. The rows with
    remainder 2 of 4 are held out. Texts are read whole, those with equal values fall on
    the same side of the threshold, and ids may be of any type."""
    small_batches(docs.sparkSession)
    learn = remainder(id_col, 4) != 2
    texts, totals = sample(
        docs, labels, "quality", learn, max_rows=max_rows, id_col=id_col, text_col=text_col
    )
    all_labels = sum(totals.values())
    constant = totals.get(1, 0) / all_labels if all_labels else 0.5
    if set(totals) != {0, 1}:
        return QualityModel(constant)
    model = fit(*_described(texts), constant)
    if model.weights is not None:
        # Values first, so that the join moves no texts.
        known = usable(labels, "quality", learn, id_col)
        valued = scored(docs, model.worth, id_col, text_col).select(
            F.col(id_col).cast("string").alias("id"), "score"
        )
        cut = F.percentile_approx("score", 1 - constant, 100_000)
        model.threshold = float(valued.join(known, "id").agg(cut).first()[0])
    return model


def quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id and ``score`` of every row of ``docs``."""
    return scored(docs, model.score, id_col, text_col)


def op10(spark, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
