"""Hard negatives of anchors, by bounds from summaries of vector segments.

Vectors are cut into segments, and each segment keeps its mean and its deviation. The
inner product of two segments of m components is m times the product of the means, plus
or minus at most m times the product of the deviations; sums of these bound the product
of two vectors from both sides. Each level has four times as many segments as the one
before. At every level a row goes whose upper bound is below the asked range or below the
k-th largest lower bound of rows that are surely inside, or whose lower bound is above the
range; what is left after the last level is scored exactly, in whole numbers.

The anchors are a stated set of queries. They are compared with all rows in tiles, blocks
of anchors by blocks of rows, of ``TILE_BYTES`` of vectors each. A tile passes on at most
k rows per question, and these are ranked once more: first the positives of each anchor,
then, with their scores as ranges, the negatives of each positive. Nothing is left out, so
recall is 1.

Results that are defined for odd input: rows without id, label or vector, or with a NULL
or non-finite component, take no part; an anchor is only compared with vectors of its own
length; rows equal in id, label and quantised vector count once, and no other row of the
anchor's id is its partner; components and scores beyond a long count as the nearest long;
ties go by the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicepulse.llm.shared import written

SCALE = 256
TILE_BYTES = 1 << 23
# Questions answered at once, and pairs looked up at once.
TOGETHER, PAIRS = 32, 1 << 16
# Share of pairs left below which they are looked up one by one.
SPARSE = 1 / 8
# Far more than the rounding of the sums, relative to the product of the norms.
SLACK = 1e-10
_LONG = 1 << 63


def quantised(vectors: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(``row``, ``id``, ``label``, ``dim``, ``q``, ``anchor``): whole numbers of the rows
    that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.where(vec.isNotNull() & ~bad).select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        F.transform(vec, lambda x: F.floor(x * SCALE)).alias("q"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows = rows.dropDuplicates(["id", "label", "q"])
    return rows.select(F.monotonically_increasing_id().alias("row"), "*", F.size("q").alias("dim"))


@dataclass
class Block:
    """Vectors of one length with their summaries."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray

    def __post_init__(self):
        self.wide = self.q.astype(float)
        dim = self.q.shape[1]
        self.levels = []
        count = 1
        while 2 * count < dim:
            edges = np.linspace(0, dim, count + 1).astype(int)
            size = np.sqrt(np.diff(edges))
            mean = np.add.reduceat(self.wide, edges[:-1], axis=1) / size
            square = np.add.reduceat(self.wide**2, edges[:-1], axis=1)
            deviation = np.sqrt(np.maximum(square - mean**2, 0))
            self.levels.append((mean, deviation))
            count *= 4
        self.norm = np.sqrt((self.wide**2).sum(axis=1)) + 1
        self.most = int(max(1, np.abs(self.wide).max(initial=0)))


def _products(a: np.ndarray, b: np.ndarray, which: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """``a[which] @ b.T`` where ``open_``; elsewhere anything."""
    if open_.mean() > SPARSE:
        return a[which] @ b.T
    out = np.zeros(open_.shape, a.dtype)
    i, j = open_.nonzero()
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        out[x, y] = (a[which[x]] * b[y]).sum(axis=1)
    return out


def _exact(anchors: Block, rows: Block, which: np.ndarray, open_: np.ndarray) -> np.ndarray:
    if anchors.most * rows.most * max(1, anchors.q.shape[1]) < 1 << 53:
        return _products(anchors.wide, rows.wide, which, open_).astype(np.int64)
    big = _products(anchors.q.astype(object), rows.q.astype(object), which, open_)
    return np.clip(big, -_LONG, _LONG - 1).astype(np.int64)


def best(
    anchors: Block, rows: Block, which: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of the first ``k`` rows for every question: those of the same
    or of other labels than anchor ``which`` with a score from ``low`` to ``high``, the
    highest first, ties by the smaller id."""
    found: tuple[list, list, list] = ([], [], [])
    rank = np.unique(rows.ids, return_inverse=True)[1]
    for at in range(0, len(which), TOGETHER):
        own, lows, highs = (x[at : at + TOGETHER] for x in (which, low, high))
        open_ = (anchors.labels[own][:, None] == rows.labels) == same
        open_ &= anchors.ids[own][:, None] != rows.ids
        under, over = lows[:, None].astype(float), highs[:, None].astype(float)
        under, over = under - 1e-9 * np.abs(under), over + 1e-9 * np.abs(over)
        slack = SLACK * anchors.norm[own][:, None] * rows.norm
        for (mean, spread), (row_mean, row_spread) in zip(anchors.levels, rows.levels):
            middle = _products(mean, row_mean, own, open_)
            reach = _products(spread, row_spread, own, open_) + slack
            open_ &= (middle + reach >= under) & (middle - reach <= over)
            sure = open_ & (middle - reach >= under) & (middle + reach <= over)
            lower = np.where(sure, middle - reach, -np.inf)
            if lower.shape[1] >= k:
                open_ &= middle + reach >= -np.partition(-lower, k - 1, axis=1)[:, k - 1 : k]
        score = _exact(anchors, rows, own, open_)
        open_ &= (score >= lows[:, None]) & (score <= highs[:, None])
        for q in range(len(own)):
            some = np.flatnonzero(open_[q])
            some = _first(some, score[q, some], rank[some], k)
            found[0].append(np.full(len(some), at + q))
            found[1].append(some)
            found[2].append(score[q, some])
    return tuple(np.concatenate([np.empty(0, np.int64), *part]) for part in found)


def _first(some: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` with the highest scores, ties by rank."""
    cut = max(0, len(score) - k)
    bound = np.partition(score, cut)[cut] if cut else -_LONG
    near = np.flatnonzero(score >= bound)
    return some[near[np.lexsort((rank[near], ~score[near]))][:k]]


def _tile(same: bool, k: int):
    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["row", "nth", "id", "score"])
        dim = int(key[0])
        anchors, rows = (
            Block(f["id"].to_numpy(), f["label"].to_numpy(), np.stack(f["q"]).reshape(len(f), dim))
            for f in (left, right)
        )
        counts = left["wants"].map(len).to_numpy()
        which = np.repeat(np.arange(len(left)), counts)
        wants = [w for own in left["wants"] for w in own]
        low, high, nth = (np.array([w[c] for w in wants], np.int64) for c in ("low", "high", "nth"))
        asked, row, score = best(anchors, rows, which, low, high, same, k)
        return pd.DataFrame(
            {
                "row": left["row"].to_numpy()[which[asked]],
                "nth": nth[asked],
                "id": rows.ids[row],
                "score": score,
            }
        )

    return compare


def _asked(rows: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """(``row``, ``nth``, ``id``, ``score``, ``rank``): the first ``k`` answers to every
    range that the ``wants`` of ``asks``, rows chosen as anchors, name."""
    per = F.floor(F.lit(TILE_BYTES) / (8 * F.greatest(F.lit(1), "dim")))
    per = F.greatest(F.lit(1).cast("long"), per)
    blocks = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / F.first(per)).alias("rows"),
        F.ceil((F.count_if("anchor") + 1) / F.first(per)).alias("asks"),
    )

    def dealt(df: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
        """Each row in its own block, beside every block of the other side."""
        block = F.pmod(F.xxhash64("row"), f"{own}s").alias(f"{own}_block")
        all_ = F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)
        return df.join(blocks, "dim").select(
            block, F.explode(all_).alias(f"{other}_block"), *[F.col(c).alias(c) for c in ["dim", *columns]]
        )

    tile = ["dim", "ask_block", "row_block"]
    left = dealt(asks, "ask", "row", ["row", "id", "label", "q", "wants"]).groupBy(tile)
    right = dealt(rows, "row", "ask", ["id", "label", "q"]).groupBy(tile)
    kind = rows.schema["id"].dataType.simpleString()
    found = left.cogroup(right).applyInPandas(
        _tile(same, k), f"row long, nth long, id {kind}, score long"
    )
    order = Window.partitionBy("row", "nth").orderBy(F.desc("score"), "id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _wanted(low: Column, high: Column, nth: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"), nth.cast("long").alias("nth"))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``) of the rows that ``anchors`` chooses: of other labels, with a score
    of ``least_percent`` of the positive's to the whole of it."""
    rows = written(quantised(vectors, anchors, id_col, vec_col, label_col), "quantised")
    asks = rows.where("anchor")
    any_score = _wanted(F.lit(-_LONG), F.lit(_LONG - 1), F.lit(0))
    near = _asked(rows, asks.withColumn("wants", F.array(any_score)), True, positives)
    near = near.select("row", F.col("rank").alias("nth"), "id", "score")
    near = written(near, "positives")
    # A range below a negative score is empty.
    least = F.ceil(F.col("score").cast("decimal(20,0)") * least_percent / 100).cast("long")
    ranges = near.where("score >= 0").groupBy("row")
    ranges = ranges.agg(F.collect_list(_wanted(least, F.col("score"), F.col("nth"))).alias("wants"))
    far = _asked(rows, asks.join(ranges, "row"), False, negatives)
    far = far.select("row", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asks.select("row", F.col("id").alias("anchor_id"))
    near = near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    return far.join(near, ["row", "nth"]).join(names, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector; every seventh has another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH quantised AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or([coalesce(NOT isfinite(x), true) for x in embedding])
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_dot_product(a.q, r.q)::BIGINT AS score
  FROM quantised a JOIN quantised r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
