"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

A document is the set of its distinct shingles of ``SHINGLE`` words. Documents with
equal sets are one node, however many there are. Each node has ``HASHES`` minima; bands
of ``ROWS`` of them make buckets, and nodes that share a bucket are candidates:

1. Every node is compared with the least node of each of its buckets, a star rather than
   all pairs, and verified links are united to components.
2. Only buckets whose nodes are still in several components are compared throughout, in
   blocks, and only across components: each pair in the first bucket that it shares, with
   the full sets at hand. A task passes on links that join components, not its pairs.

A comparison reads the signatures batch by batch and gives a pair up once the posterior
probability that its similarity reaches the threshold, with a uniform prior, falls below
``MISS``. Survivors are confirmed on their full sets, which are made again from the
texts of the nodes concerned.

Results that are defined for odd input: NULL, empty and all-white text has the empty set
and links with nothing; very long texts are read whole; repeated rows are copies; NULL
ids never name a component unless all its ids are NULL; an empty table gives no rows;
other columns are ignored (``near_duplicates``) or kept whatever their names
(``one_of_each``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StructType

from devicepulse.llm.shared import components, same, small_batches, written
from devicepulse.llm.words import WordHasher, mix

SHINGLE = 5
PERCENT = 75
HASHES, ROWS, BANDS, BATCH = 256, 5, 32, 32
MISS = 1e-5
BLOCK = 1_024

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_DRAW = np.random.default_rng(5)
_TIMES = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32)
# Signatures keep a byte of each minimum; bytes of different minima agree so often.
_CHANCE = 1 / 256
# Shingles that are hashed together.
_STEP = 1_024
# Bits of the sieve that keeps most texts that are not wanted out of a shuffle.
SIEVE = 1 << 23
_PAGE = 1 << 15


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of a document as sorted 64-bit numbers, from the hashes of its words."""
    if not len(words):
        return np.empty(0, np.uint64)
    wide = min(SHINGLE, len(words))
    count = len(words) - wide + 1
    out = words[:count]
    for place in range(1, wide):
        out = mix(out * _ODD + words[place : place + count])
    return np.unique(mix(out + np.uint64(wide)))


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each of ``HASHES`` permutations over a non-empty set."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _STEP):
        part = low[at : at + _STEP, None] * _TIMES
        part += _PLUS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One number per band; equal minima of a band give equal numbers."""
    rows = least[: ROWS * BANDS].astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for place in range(ROWS):
        out = mix(out * _ODD + rows[:, place])
    return out.view(np.int64)


def needed(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """Per batch, the fewest agreeing bytes so far at which a pair is not given up.

    With m of n in agreement the posterior of the rate of agreement is Beta(m+1, n-m+1),
    and its mass above x is the chance of at most m hits in n + 1 draws of rate x.
    """
    x = threshold + (1 - threshold) * _CHANCE
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return out


NEEDED = needed()


def promising(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two byte matrices stay in all batches. The hashes that made no band
    come first, as agreement there is not why the pair is a candidate."""
    alive = np.arange(len(left))
    agree = np.zeros(len(left), int)
    for batch, least in enumerate(NEEDED):
        at = slice(HASHES - (batch + 1) * BATCH, HASHES - batch * BATCH)
        agree[alive] += (left[alive, at] == right[alive, at]).sum(axis=1)
        alive = alive[agree[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HASHES)


@pandas_udf(BooleanType())
def _promising(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(promising(_bytes(left), _bytes(right)) if len(left) else [], dtype=bool)


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    both = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return 100 * both >= PERCENT * (len(one) + len(two) - both)


@pandas_udf(BooleanType())
def _linked(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = zip(left, right)
    found = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs]
    return pd.Series(found, dtype=bool)


def _node(items: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(items.tobytes())


def _raw(text_col: str) -> Column:
    """UTF-8 bytes, which need no decoding in the Python workers."""
    return F.coalesce(text_col, F.lit("")).cast("binary")


@pandas_udf(StructType().add("n", "long").add("node", "string"))
def _node_of(text: pd.Series) -> pd.DataFrame:
    """Size and node of the set of each text; no node for the empty set."""
    sets = (shingles(words) for words in WordHasher().each(text))
    rows = [(len(s), _node(s) if len(s) else None) for s in sets]
    return pd.DataFrame(rows, columns=["n", "node"])


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``n``, ``node``, ``bands``, ``sig``) of the rows whose set is not empty."""
    narrow = docs.select(F.col(id_col).alias("id"), _raw(text_col).alias("text"))
    schema = StructType([narrow.schema[0]]).add("n", "long").add("node", "string")
    schema = schema.add("bands", "binary").add("sig", "binary")

    def batches(frames):
        for frame in frames:
            rows, there = [], []
            for words in WordHasher().each(frame["text"]):
                items = shingles(words)
                there.append(len(items) > 0)
                if not len(items):
                    continue
                least = minima(items)
                sig = least.astype(np.uint8).tobytes()
                rows.append((len(items), _node(items), band_keys(least).tobytes(), sig))
            out = pd.DataFrame(rows, columns=["n", "node", "bands", "sig"])
            out.insert(0, "id", frame["id"][np.array(there, bool)].reset_index(drop=True))
            yield out

    return narrow.mapInPandas(batches, schema)


def _in_buckets(nodes: DataFrame) -> DataFrame:
    """(``bucket``, ``band``, ``num``) for every band of every node."""

    def batches(frames):
        for frame in frames:
            bands = np.frombuffer(b"".join(frame["bands"]), np.int64)
            nums = np.repeat(frame["num"].to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int8), len(frame))
            yield pd.DataFrame({"bucket": bands, "band": band, "num": nums})

    return nodes.select("num", "bands").mapInPandas(batches, "bucket long, band byte, num long")


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SIEVE))


def _sieved(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``. The sieve has
    a fixed size; with very many values it merely lets more rows through."""
    bit = _bit(column)
    pages = wanted.groupBy(F.floor(bit / _PAGE).alias("page"))
    pages = pages.agg(F.bitmap_construct_agg((bit % _PAGE).cast("long")).alias("bits"))
    sieve = np.zeros((SIEVE // _PAGE, _PAGE // 8), np.uint8)
    for row in pages.collect():  # at most SIEVE bits
        sieve[row.page] = np.frombuffer(row.bits, np.uint8)
    sieve = sieve.ravel()

    @pandas_udf(BooleanType())
    def marked(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy()
        return pd.Series((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1, dtype=bool)

    return rows.where(marked(bit))


def _sets(docs: DataFrame, nodes: DataFrame, nums: DataFrame, id_col: str, text_col: str):
    """(``num``, ``items``) of the nodes in ``nums``, from the text of one document each."""
    wanted = written(nodes.select("num", "node", "least").join(nums, "num"), "wanted")
    texts = docs.select(F.col(id_col).alias("id"), _raw(text_col).alias("text"))
    ids = wanted.select(F.col("least").alias("id")).distinct()
    found = same(_sieved(texts, ids, "id"), ids, ["id"]).select("text")

    def batches(frames):
        for frame in frames:
            sets = [shingles(w) for w in WordHasher().each(frame["text"])]
            rows = [(_node(s), s.tobytes()) for s in sets if len(s)]
            yield pd.DataFrame(rows, columns=["node", "items"])

    made = found.mapInPandas(batches, "node string, items binary")
    # A node has one number, so the sets are shuffled once.
    made = made.groupBy("node").agg(F.first("items").alias("items"))
    return written(made.join(wanted.select("num", "node"), "node").select("num", "items"), "sets")


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``columns`` of both nodes, named ``a_…`` and ``b_…``."""
    for side in ("a", "b"):
        named = table.select(
            F.col("num").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]
        )
        pairs = pairs.join(named, side)
    return pairs


def _confirmed(pairs: DataFrame, docs, nodes, id_col: str, text_col: str) -> DataFrame:
    """The ``pairs`` whose full sets are similar enough."""
    nums = pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct()
    sets = _sets(docs, nodes, nums, id_col, text_col)
    links = _beside(pairs, sets, ["items"]).where(_linked("a_items", "b_items"))
    return written(links.select("a", "b"), "confirmed")


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of a bucket, or one: links that join different components."""
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    band = int(frame["band"].iloc[0])
    frame = frame.sort_values("num", ignore_index=True)
    own, n, nums = (frame[c].to_numpy() for c in ("own", "n", "num"))
    sigs = _bytes(frame["sig"])
    keys = np.frombuffer(b"".join(frame["bands"]), np.int64).reshape(-1, BANDS)[:, :band]
    sets = [np.frombuffer(items, np.uint64) for items in frame["items"]]
    root, links = frame["root"].to_numpy().copy(), []
    for i in np.flatnonzero(own == low):
        fits = 100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])
        fits &= (own == high) & ((nums > nums[i]) | (low != high)) & (root != root[i])
        fits &= ~(keys == keys[i]).any(axis=1)
        some = np.flatnonzero(fits)
        some = some[promising(np.broadcast_to(sigs[i], (len(some), HASHES)), sigs[some])]
        agree = (sigs[some] == sigs[i]).sum(axis=1)
        for j in some[np.argsort(-agree, kind="stable")]:
            if root[j] != root[i] and similar(sets[i], sets[j]):
                links.append((nums[i], nums[j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``node``, ``root``) by number for every node that is linked with another."""
    buckets = _in_buckets(nodes)
    heads = buckets.groupBy("bucket").agg(F.min("num").alias("head"), F.count("*").alias("size"))
    heads = written(heads.where("size > 1"), "heads")
    shared = written(_sieved(buckets, heads, "bucket").join(heads, "bucket"), "buckets")
    # Most nodes share no bucket: only the others are shuffled from here on.
    busy = written(_sieved(nodes.drop("node", "least"), shared, "num"), "busy")
    sizes = 100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")
    stars = shared.where("num <> head").select(F.col("num").alias("a"), F.col("head").alias("b"))
    stars = _beside(stars.distinct(), busy, ["n", "sig"]).where(sizes)
    stars = written(stars.where(_promising("a_sig", "b_sig")).select("a", "b"), "stars")
    links = _confirmed(stars, docs, nodes, id_col, text_col)
    roots = written(components(links, "stars"), "roots")
    # Buckets that still hold several components.
    named = shared.where("size > 2").join(roots.withColumnRenamed("node", "num"), "num", "left")
    named = named.select("bucket", "band", "num", "size", F.coalesce("root", "num").alias("root"))
    named = written(named, "named")
    mixed = named.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other"))
    mixed = written(mixed.where("one <> other").select("bucket"), "mixed")
    open_ = written(named.join(mixed, "bucket"), "open")
    sets = _sets(docs, nodes, open_.select("num").distinct(), id_col, text_col)
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("num"), blocks))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high")
    dealt = dealt.select("bucket", "band", low, high, "own", "num", "root")
    dealt = dealt.join(busy.select("num", "n", "sig", "bands"), "num").join(sets, "num")
    rest = dealt.groupBy("bucket", "low", "high").applyInPandas(_across, "a long, b long")
    more = written(rest.distinct(), "rest")
    return components(links.unionByName(more), "documents")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``."""
    return _decided(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    nodes = _signed(docs, id_col, text_col).groupBy("node")
    nodes = nodes.agg(
        *[F.first(c).alias(c) for c in ("n", "bands", "sig")], F.min("id").alias("least")
    )
    nodes = written(nodes.withColumn("num", F.monotonically_increasing_id()), "nodes")
    roots = written(_links(docs, nodes, id_col, text_col), "components")
    known = nodes.select("num", "node", "least").join(
        roots.withColumnRenamed("node", "num"), "num", "left"
    )
    known = known.withColumn("root", F.coalesce("root", "num"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(known.join(least, "root").select("node", "root", "component_id"), "known")
    rows = docs.select(F.col(id_col).alias("id"), _node_of(_raw(text_col)).alias("of"))
    joined = rows.select("id", "of.n", "of.node").join(known, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", "n", "node", "root", component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, with
    its least id, and all rows without words."""
    decided = _decided(docs, id_col, text_col).where("n > 0 AND id <=> component_id")
    stays = decided.groupBy("root").agg(F.min(F.struct("id", "node")).alias("stays"))
    stays = stays.select(F.col("stays.id").alias(id_col), F.col("stays.node").alias("node"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    tagged = docs.select(id_col, _node_of(_raw(text_col))["node"].alias("node"), row.alias("row"))
    found = same(tagged, stays, [id_col, "node"]).groupBy(id_col, "node").agg(F.first("row").alias("row"))
    found = found.select("row").unionByName(tagged.where("node IS NULL").select("row"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document with its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
