"""Toxicity by compression distance between two zstandard dictionaries.

Words are spelled as codes of 16 bytes, so that compressed lengths count words and not
letters (a match costs about as much as five letters, but much less than such a code),
and a text is cut into windows of ``WINDOW`` words. One dictionary holds the words of
ordinary text, the other those and the words that mark toxic text; both are learned from
documents of the two kinds. A window that is shorter under the second
contains marking words: the lengths of windows with none differ by a byte or so. The
differences of all windows of a document are condensed to a few figures, and logistic
weights for these are calibrated on labelled documents that the dictionaries have not
seen.

Results that are defined for odd input: NULL and empty text has one empty window; a
very long text has as many windows as it needs; repeated rows get equal scores; without
labels of both classes every score is the share of toxic labels, one half without any;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from devicepulse.llm.labelled import logistic, remainder, sample, scored, squash
from devicepulse.llm.shared import small_batches, written
from devicepulse.llm.words import PUNCTUATION, WHITE, WordHasher, mix

WINDOW = 16
LEVEL = 3
CODE = 16
# Bytes by which the two lengths of a window without marking words may differ.
SLACK = 4
# Sizes of the dictionaries in words.
ORDINARY_WORDS = 4_096
TOXIC_WORDS = 2_048
# A word that this many toxic documents hold marks toxic text if it is ``FAR`` times as
# frequent there as in ordinary documents, or ``MORE`` times as frequent with a log odds
# ratio of at least ``SURE`` standard errors.
LEAST_DOCS = 4
FAR, MORE, SURE = 30.0, 3.0, 5.0


def _words(texts: list[str]) -> Iterator[np.ndarray]:
    return WordHasher(WHITE + PUNCTUATION).each(texts)


def _spelled(words: np.ndarray) -> bytes:
    return np.stack([words, mix(words + np.uint64(1))], axis=1).tobytes()


def _content(words: list[int]) -> bytes:
    """The first word is the most important one: it goes to the end, nearest to the data."""
    return _spelled(np.array(words[::-1], np.int64).view(np.uint64))


@dataclass
class ToxicityModel:
    """Two dictionaries and calibrated weights; without dictionaries a constant."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    constant: float = 0.5

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(content, dict_type=kind)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False
        )

    def figures(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """Per text, given by the hashes of its words: bytes saved by the toxic dictionary beyond the slack, in total, per
        window and at most, the share of windows that save any, their number, and 1."""
        toxic, ordinary = self._compressor(self.toxic), self._compressor(self.ordinary)
        rows, wide = [], CODE * WINDOW
        for data in map(_spelled, texts):
            saved = [
                len(ordinary.compress(part)) - len(toxic.compress(part))
                for part in (data[k : k + wide] for k in range(0, max(len(data), 1), wide))
            ]
            saved = np.maximum(np.array(saved) - SLACK, 0)
            total, hits, windows = saved.sum(), (saved > 0).sum(), len(saved)
            rows.append(
                [
                    np.log1p(total),
                    np.sqrt(total / windows),
                    saved.max(),
                    hits / windows,
                    np.log(windows),
                    1,
                ]
            )
        return np.array(rows, float).reshape(len(rows), 6)

    def score(self, texts: list[str]) -> list[float]:
        """From 0 to 1, higher for toxic texts."""
        if not self.weights:
            return [self.constant] * len(texts)
        return [squash(v) for v in self.figures(_words(texts)) @ np.array(self.weights)]


def _learned(counts: DataFrame, n: dict[int, int]) -> ToxicityModel:
    """The dictionaries from (``word``, ``n0``, ``n1``): how many of the ``n`` ordinary
    and toxic documents hold a word."""
    toxic, plain = F.col("n1"), F.col("n0") + 0.5
    ratio = toxic / n[1] * n[0] / plain
    sure = F.log(ratio) / F.sqrt(1 / toxic + 1 / plain)
    mark = (toxic >= LEAST_DOCS) & ((ratio >= FAR) | ((ratio >= MORE) & (sure >= SURE)))
    marks = counts.where(mark).orderBy(F.desc("n1"), "word").limit(TOXIC_WORDS)
    marks = [r.word for r in marks.collect()]
    common = counts.where("n0 > 0").orderBy(F.desc("n0"), "word").limit(ORDINARY_WORDS)
    chosen = set(marks)
    ordinary = [r.word for r in common.collect() if r.word not in chosen]
    return ToxicityModel(_content(ordinary), _content([*marks, *ordinary]))


def fit(texts: DataFrame, totals: dict[int, int]) -> ToxicityModel:
    """A model from (``text``, ``y``), distinct texts; ``totals`` are the sizes of the
    classes. Two thirds of each class make the dictionaries, the rest calibrate. Texts
    stay in the tasks: the driver gets words, and six figures per text."""
    all_labels = sum(totals.values())
    constant = totals.get(1, 0) / all_labels if all_labels else 0.5
    if set(totals) != {0, 1}:
        return ToxicityModel(constant=constant)

    def hashed(frames):
        for frame in frames:
            words = [w.astype("<u8").tobytes() for w in _words(frame["text"].tolist())]
            yield pd.DataFrame({"key": frame["key"], "y": frame["y"], "words": words})

    def held(frames):
        for frame in frames:
            pairs = [
                (int(y), word)
                for y, words in zip(frame["y"], frame["words"])
                for word in np.unique(np.frombuffer(words, "<i8")).tolist()
            ]
            yield pd.DataFrame(pairs, columns=["y", "word"])

    small_batches(texts.sparkSession)
    keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("key"), "y", "text")
    table = written(keyed.mapInPandas(hashed, "key string, y int, words binary"), "labelled")
    # A sample of bounded size: so a class may be one group.
    place = F.row_number().over(Window.partitionBy("y").orderBy("key")) % 3
    places = written(table.select("key", "y", place.alias("place")), "places")
    n = {r.y: r.n for r in places.where("place <> 2").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return ToxicityModel(constant=constant)
    shape = table.join(places.where("place <> 2").select("key"), "key", "left_semi")
    counts = shape.mapInPandas(held, "y int, word long").groupBy("word").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    model = _learned(counts, n)
    model.constant = constant

    def measured(frames):
        for frame in frames:
            rows = model.figures(np.frombuffer(w, "<u8") for w in frame["words"])
            yield pd.DataFrame({"key": frame["key"], "y": frame["y"], "x": rows.tolist()})

    check = table.join(places.where("place = 2").select("key"), "key", "left_semi")
    rows = check.mapInPandas(measured, "key string, y int, x array<double>").toPandas()
    rows = rows.sort_values("key")
    y = rows["y"].to_numpy(float)
    if set(y) != {0, 1} or not model.ordinary:
        return ToxicityModel(constant=constant)
    share = {c: totals[c] / (y == c).sum() for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight *= len(y) / weight.sum()
    model.weights = logistic(np.array(rows["x"].tolist(), float), y, weight, 0.1).tolist()
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents per class, whole texts of any
    length. The rows with remainder 1 of 3 are held out. Ids may be of any type, and
    words that tie at the end of a dictionary are taken by their hash."""
    learn = remainder(id_col, 3) != 1
    some = sample(
        docs, labels, "toxic", learn, max_rows=max_rows, id_col=id_col, text_col=text_col
    )
    return fit(*some)


def toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id and ``score`` of every row of ``docs``."""
    return scored(docs, model.score, id_col, text_col)


def accepted(
    docs: DataFrame, model: ToxicityModel, cut: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with scores below ``cut``, with all their columns."""

    small_batches(docs.sparkSession)

    @pandas_udf(BooleanType())
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([s < cut for s in model.score(text.tolist())], dtype=bool)

    return docs.where(clean(F.coalesce(text_col, F.lit(""))))


def op9(spark, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
