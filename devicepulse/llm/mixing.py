"""Mixing of sources by temperature, realised as budgeted block permutations.

A source with a share p of all tokens gets a weight proportional to p to the power of an
exponent: 1 keeps the shares, 0 makes all sources equal. The exponent is narrowed down
until the weights have a wanted entropy, or until no source is repeated more often than
a limit allows. Every step of the search evaluates ``GRID`` exponents in one aggregate
over the table of sources, so not even the sources pass through the driver.

The weights and the budget of tokens say how often a source is gone through. Each time is
a permutation of its own, by a hash of the row, and the budget ends the last one after
the token that meets it. The passes of all sources are laid side by side and cut into
``blocks`` of equal budget, so that each block holds all sources by their weights.

A row counts its words and one for its end as tokens. Results that are defined for odd
input: NULL is a source of its own; NULL and empty texts have one token; rows that
repeat id and text share their places, so the end of a budget takes all or none of
them; an empty table gives no rows; other columns are ignored (``schedule``) or kept
whatever their names (``mixed``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicepulse.llm.shared import ranked, same, written

GRID = 32
# Exponents are sought between these.
FLATTEST, STEEPEST = 0.0, 8.0
WORD = r"[^\x20\x09-\x0D]+"


def _tokens(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
    return (words + 1).cast("long")


def _order(key: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(key, epoch, F.lit(seed))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        _tokens(F.col(text_col)).alias("tokens"),
        F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias("key"),
    )


def _search(good: Callable[[list[float]], list[bool]]) -> float:
    """The least exponent that is good; all above a good one are good."""
    low, high = FLATTEST, STEEPEST
    if good([low])[0]:
        return low
    while high - low > 1e-9:
        points = [low + (high - low) * i / GRID for i in range(1, GRID + 1)]
        first = next((i for i, ok in enumerate(good(points)) if ok), GRID - 1)
        low, high = (points[first - 1] if first else low), points[first]
    return high


def exponent(
    sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None
) -> float:
    """The flattest exponent at which no source is repeated more than ``max_repeats``
    times while the least repeated one is gone through once, or at which the weights have
    at most the ``entropy`` in nats. ``sources`` has ``tokens`` of at least 1 per row."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    bounds = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    total, most, least = bounds
    if not total:
        return 1.0
    if max_repeats is not None:
        if max_repeats < 1:
            raise ValueError("max_repeats is at least 1")
        return _search(lambda points: [(most / least) ** (1 - a) <= max_repeats for a in points])
    share = F.col("tokens") / F.lit(total)

    def flat_enough(points: list[float]) -> list[bool]:
        power = [F.pow(share, F.lit(a)) for a in points]
        sums = [F.sum(p) for p in power] + [F.sum(p * F.ln(p)) for p in power]
        row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        size, logs = row[: len(points)], row[len(points) :]
        # Entropy of p / z is ln z - sum(p ln p) / z.
        return [math.log(z) - x / z <= entropy for z, x in zip(size, logs)]

    return _search(flat_enough)


def weights(docs: DataFrame, power: float, budget: int | None, source_col: str) -> DataFrame:
    """Per source: ``tokens``, ``weight`` and ``repeats``. Without a ``budget`` the least
    repeated source is gone through once."""
    sources = docs.groupBy(source_col).agg(F.sum("tokens").alias("tokens"))
    raw = sources.withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    sums = raw.agg(F.sum("raw").alias("z"), F.min(F.col("raw") / F.col("tokens")).alias("lowest"))
    once = F.lit(float(budget)) * F.col("raw") / F.col("z") if budget else F.col("raw") / F.col("lowest")
    repeats = F.round(once / F.col("tokens"), 9)
    # One row of sums beside each source.
    return raw.join(F.broadcast(sums)).select(
        source_col, "tokens", (F.col("raw") / F.col("z")).alias("weight"), repeats.alias("repeats")
    )


def _planned(
    docs: DataFrame,
    blocks: int,
    max_repeats: float | None,
    entropy: float | None,
    budget: int | None,
    seed: int,
    columns: tuple[str, str, str],
) -> tuple[DataFrame, DataFrame]:
    """The placed rows and the sources."""
    narrow = written(_narrow(docs, *columns), "mix-rows")
    totals = written(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    power = exponent(totals, max_repeats, entropy)
    sources = weights(narrow, power, budget, "source").withColumnRenamed("tokens", "all")
    sources = written(sources, "mix-sources")
    epochs = F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1)
    rows = same(narrow, sources.where("repeats > 0"), ["source"])
    rows = rows.withColumn("epoch", F.explode(epochs))
    rows = rows.withColumn("order", _order(F.col("key"), F.col("epoch"), seed))
    keys = ["source", "epoch"]
    placed = ranked(rows, keys, ["order", "id"], ["tokens"], "mix-order")
    place = F.col("epoch") * F.col("all") + F.col("tokens_before")
    end = F.col("repeats") * F.col("all")
    placed = placed.where(place < end).withColumn("block", F.floor(place / end * blocks).cast("int"))
    return placed, sources


def schedule(
    docs: DataFrame,
    *,
    blocks: int = 64,
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per time a row of ``docs`` is used: id, source, ``epoch``, ``tokens``,
    ``weight`` and ``repeats`` of the source, ``block``, and ``place``, by which the rows of
    a block are sorted."""
    columns = (id_col, text_col, source_col)
    placed, _ = _planned(docs, blocks, max_repeats, entropy, budget, seed, columns)
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "epoch",
        "tokens",
        "weight",
        "repeats",
        "block",
        F.col("order").alias("place"),
    )


def mixed(
    docs: DataFrame,
    *,
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``schedule`` uses it.

    A pass that the budget ends is told by the last order number that it takes, one per
    source, so the rows themselves are only filtered and repeated.
    """
    columns = (id_col, text_col, source_col)
    placed, sources = _planned(docs, 1, max_repeats, entropy, budget, seed, columns)
    last = F.ceil("repeats") - 1
    cuts = placed.where(F.col("epoch") == last).groupBy("source").agg(F.max("order").alias("cut"))
    plan = same(sources.where("repeats > 0"), cuts, ["source"], "left")
    plan = written(plan.select("source", last.cast("int").alias("last"), "cut"), "mix-plan")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key = F.xxhash64(id_col, F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.col(source_col).alias("source"), key.alias("key"), row.alias("row"))
    rows = same(rows, plan, ["source"])
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    taken = (F.col("epoch") < F.col("last")) | (_order(F.col("key"), F.col("epoch"), seed) <= F.col("cut"))
    found = rows.where(taken)
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2(spark, sf_dir: str) -> DataFrame:
    """The documents mixed so that no source is gone through more than twice."""
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_repeats=2.0)
