"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector by random projections with random shifts, cut into cells, and
sorts all vectors of one length by their concatenated hashes. Every vector is compared
with the next ``WINDOW`` of this order. Vectors that share the whole front of a pass, its
first hashes, lie side by side; a stretch of them that is longer than the window is
compared whole, in tiles where it is long, so a crowd of any size loses nothing. The
verified pairs of all passes are united to components. A task passes on which of its
vectors are connected, not its pairs.

The chance that two vectors share the front depends on their distance alone, not on where
they lie or how dense it is there, so the number of passes follows from the cell width,
the length of the front and ``miss``: each pair of the threshold or above is met by some
pass but for a chance of at most ``miss``. Of all widths and lengths with this promise the
cheapest for the crowding that a sample of the vectors shows are taken; the sample decides
about costs only. An order that fits into one window is compared whole in its one pass.

The links of each vector are counted at the end by comparing the blocks of its component
with each other, exactly.

Vectors that are equal bit by bit after scaling to length one are handled as one with a
multiplicity, so copies are neither hashed nor compared again.

Results that are defined for odd input: vectors that are NULL, empty, zero or hold NULL
or non-finite components, and vectors of different lengths, link with nothing; NULL ids
count as links but never name a component unless all its ids are NULL; repeated rows
are copies, and so are rows that share an id; ties in an order come by their hash; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StructType

from devicepulse.llm.shared import components, ranked, written

BLOCK = 512
# Later neighbours in the order of a pass that a vector is compared with at least.
WINDOW = 512
# Places of an order that one task compares, and hashes behind the front that order them.
RUN, FINER = 8_192, 4
# Sizes of a tile: vectors at most, bytes at most.
TILE, TILE_BYTES = 32_768, 1 << 24
# Comparisons that cost as much as moving a vector to a further task.
SHIP = 8_192
# Vectors of one length that decide about the cells, and the draws they are tried on.
SAMPLE, DRAWS = 1_024, 4


def _scaled(rows: np.ndarray) -> np.ndarray:
    """The rows in double precision and of length one; not finite where that fails."""
    rows = rows.astype(np.float64)
    with np.errstate(all="ignore"):
        rows /= np.abs(rows).max(axis=1, keepdims=True, initial=0)  # squares do not overflow
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows + 0.0


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``id``, ``node``, ``dim``, ``raw``): the vector as bytes in its own precision, and
    a 128-bit hash of it scaled to length one; NULL for one that links with nothing."""
    kind = _precision(vectors, vec_col)
    narrow = vectors.select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    schema = StructType([narrow.schema[0]])
    schema = schema.add("node", "string").add("dim", "integer").add("raw", "binary")

    def unit(vec) -> tuple:
        if vec is None or not len(vec):
            return (None, None, None)
        vec = np.array(vec, float).astype(kind)  # a NULL component becomes NaN
        whole = _scaled(vec[None])
        if not np.isfinite(whole).all():
            return (None, None, None)
        return (xxhash.xxh3_128_hexdigest(whole.tobytes()), len(vec), vec.tobytes())

    def batches(frames):
        for frame in frames:
            out = pd.DataFrame(map(unit, frame["vec"]), columns=["node", "dim", "raw"])
            out["dim"] = out["dim"].astype("Int32")
            out.insert(0, "id", frame["id"])
            yield out

    return narrow.mapInPandas(batches, schema)


def _precision(vectors: DataFrame, vec_col: str) -> str:
    """What the components are moved as: no more bytes than they come with."""
    return "f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "f8"


@dataclass(frozen=True)
class Cells:
    """``passes`` times ``number`` projections, cut into cells of ``width``."""

    width: float
    number: int
    passes: int

    def keys(self, units: np.ndarray, seed: int, p: int) -> tuple[list[bytes], list[bytes]]:
        """Front and finer rest of the concatenated hashes in pass ``p``; their bytes sort
        like the hashes."""
        draw = np.random.default_rng([seed, p, units.shape[1]])
        front = _cells(units, self.width, self.number, draw)
        rest = _cells(units, self.width / 4, FINER, draw)
        return _sortable(front), _sortable(rest)


def _sortable(cells: np.ndarray) -> list[bytes]:
    half = 1 << 31  # cells beyond it share the outermost one
    return [row.tobytes() for row in (cells.clip(-half, half - 1) + half).astype(">u4")]


def _cells(units: np.ndarray, width: float, number: int, draw) -> np.ndarray:
    lines = draw.standard_normal((units.shape[1], number))
    return np.floor(units @ lines / width + draw.random(number)).astype(np.int64)


# A front without hashes: all vectors are one stretch.
WHOLE = Cells(1.0, 0, 1)


def _together(u: float) -> float:
    """The chance that a projection keeps two vectors in one cell that is ``u`` times as
    wide as their distance; the nearer, the more."""
    return math.erf(u / math.sqrt(2)) - math.sqrt(2 / math.pi) / u * -math.expm1(-u * u / 2)


def cheapest(
    units: np.ndarray, n: int, threshold: float, miss: float, ship: float = SHIP
) -> Cells:
    """The cheapest cells for ``n`` vectors of which ``units`` is a sample."""
    reach = math.sqrt(max(2 - 2 * threshold, 1e-12)) * (1 + 1e-9)
    best, found = math.inf, WHOLE
    above = np.triu_indices(len(units), 1)
    for u in (2, 3, 4, 6, 8, 12, 16, 24):
        shared = np.zeros(48)
        for d in range(DRAWS):
            cells = _cells(units, u * reach, len(shared), np.random.default_rng([d, 1]))
            i, j = above
            for k in range(len(shared)):
                same = cells[i, k] == cells[j, k]
                i, j = i[same], j[same]
                shared[k] += (len(i) + 1) / len(above[0]) / DRAWS
        for k, crowd in enumerate(shared, 1):
            kept = _together(u) ** k
            passes = max(1, math.ceil(math.log(miss) / math.log1p(-kept)))
            cost = passes * (crowd * n + 2 * WINDOW + ship)
            if cost < best:
                best, found = cost, Cells(u * reach, k, passes)
    return found


def _plans(nodes: DataFrame, kind: str, threshold: float, miss: float) -> dict[int, Cells]:
    """The cells of each length of which one window does not hold all vectors."""
    plans = {}
    for dim, n in nodes.groupBy("dim").count().where(F.col("count") > WINDOW).collect():
        some = nodes.where(F.col("dim") == dim).orderBy("node").select("raw").limit(SAMPLE)
        plans[dim] = cheapest(_matrix(some.toPandas(), kind), n, threshold, miss)
    return plans


def _keys(nodes: DataFrame, kind: str, plans: dict[int, Cells], seed: int) -> DataFrame:
    """(``pass``, ``dim``, ``front``, ``rest``, ``node``): each node's hashes in each pass."""

    def batches(frames):
        for frame in frames:
            for dim, some in frame.groupby("dim"):
                cells, units = plans.get(dim, WHOLE), _matrix(some, kind)
                for p in range(cells.passes):
                    front, rest = cells.keys(units, seed, p)
                    yield pd.DataFrame(
                        {"pass": p, "dim": dim, "front": front, "rest": rest, "node": some["node"]}
                    )

    return nodes.select("node", "dim", "raw").mapInPandas(
        batches, "pass int, dim int, front binary, rest binary, node string"
    )


def _matrix(frame: pd.DataFrame, kind: str) -> np.ndarray:
    """The vectors of ``raw``, scaled."""
    return _scaled(np.stack([np.frombuffer(r, kind) for r in frame["raw"]]))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, the least place of each component, after the links ``a`` - ``b``."""
    while True:
        a_label, b_label = label[a], label[b]
        open_ = a_label != b_label
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        low, high = np.minimum(a_label, b_label)[open_], np.maximum(a_label, b_label)[open_]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def _near(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that reach the threshold. Products in single precision decide
    all but those that their rounding error leaves open."""
    slack = (left.shape[1] + 8) * 2.0**-23
    rough = left.astype(np.float32) @ right.astype(np.float32).T
    a, b = (rough >= threshold - slack).nonzero()
    sure = rough[a, b] >= threshold + slack
    for open_ in np.array_split((~sure).nonzero()[0], 1 + (~sure).sum() // 65_536):
        sure[open_] = (left[a[open_]] * right[b[open_]]).sum(axis=1) >= threshold
    return a[sure], b[sure]


def _connected(threshold: float, kind: str, cells: int = 1 << 22):
    """Each vector of a run of an order, or of two tiles of a long stretch or one, with the
    first one it is connected to. ``cells`` products are in memory at once."""

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, _, start, low, high = key
        if start == RUNS:
            frame = frame.sort_values("place")
            own = int((frame["place"] // frame["run"].max()).eq(low).sum())
            front = frame["front"].to_numpy()
            ends = np.append(np.flatnonzero(front[1:] != front[:-1]) + 1, len(front))
            ends = ends[np.searchsorted(ends, np.arange(len(front)), "right")]
            first, step = 0, BLOCK
        else:
            frame = pd.concat([frame[frame["own"] == t] for t in dict.fromkeys((low, high))])
            own = int((frame["own"] == low).sum())
            first = 0 if low == high else own
            step = max(1, cells // max(1, len(frame) - first))
        units, nodes = _matrix(frame, kind), frame["node"].to_numpy()
        n = len(nodes)
        label = np.arange(n)
        for i in range(0, own, step):
            j = min(i + step, own)
            left, right = first, n
            if start == RUNS:  # all that follow in the window or share the front
                left, right = i, max(min(j + WINDOW, n), ends[j - 1])
            a, b = _near(units[i:j], units[left:right], threshold)
            label = _unite(label, a + i, b + left)
        joined = label != np.arange(n)
        return pd.DataFrame({"a": nodes[joined], "b": nodes[label[joined]]})

    return compare


# Stands for the start of a stretch where a run of the order is meant.
RUNS = -1


def _vectors_at_once(most: int) -> Column:
    """Vectors of length ``dim`` that a task takes: ``most``, fewer if they are long."""
    return F.greatest(F.lit(WINDOW), F.least(F.lit(most), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))


def _links(nodes: DataFrame, kind: str, threshold: float, miss: float, seed: int) -> DataFrame:
    """Connected pairs (``a``, ``b``) of all passes.

    A run of the order and the window after it go to one task, which also compares the
    stretches inside. Of those stretches that no run holds whole and no window spans, the
    tiles are compared with each other, and only their ends go to the runs as well. Which these are follows from the fronts at
    the ends of the runs, so no key of the join or the window is hot.
    """
    by = ["pass", "dim"]
    keys = written(_keys(nodes, kind, _plans(nodes, kind, threshold, miss), seed), "keys")
    keys = keys.withColumn("one", F.lit(1).cast("long"))
    place, zero = F.col("one_before").alias("place"), F.lit(0).cast("long")
    placed = ranked(keys, by, ["front", "rest", "node"], ["one"], "orders").where("one_total > 1")
    placed = placed.select(*by, "front", "node", place, _vectors_at_once(RUN).alias("run"))
    placed = placed.withColumn("at", F.floor(F.col("place") / F.col("run")))
    # The long stretches that cross a boundary of runs.
    parts = placed.groupBy(*by, "front", "at", "run").agg(
        F.count("*").alias("n"), F.min("place").alias("least"), F.max("place").alias("last")
    )
    parts = parts.where((F.col("least") % F.col("run") == 0) | ((F.col("last") + 1) % F.col("run") == 0))
    stretch = Window.partitionBy(*by, "front")
    parts = parts.select(
        *by,
        "front",
        "at",
        F.sum("n").over(stretch).alias("total"),
        F.min("least").over(stretch).alias("start"),
        F.count("*").over(stretch).alias("crossed"),
    )
    parts = parts.where((F.col("crossed") > 1) & (F.col("total") > WINDOW))
    placed = placed.join(parts, [*by, "front", "at"], "left")
    # The runs, each with the window that follows it. What lies deep inside a crossing
    # stretch has its whole window there.
    end = F.col("start") + F.col("total")
    deep = (F.col("place") >= F.col("start") + WINDOW) & (F.col("place") < end - WINDOW)
    after = (F.col("at") > 0) & (F.col("place") % F.col("run") < WINDOW)
    runs = F.when(after, F.array(F.col("at") - 1, "at")).otherwise(F.array("at"))
    shallow = placed.where(~F.coalesce(deep, F.lit(False))).withColumn("low", F.explode(runs))
    in_runs = shallow.select(
        *by, F.lit(RUNS).cast("long").alias("start"), "low", "place", "run", "front", "node"
    )
    in_runs = in_runs.select("*", F.col("low").alias("high"), zero.alias("own"))
    crossing = placed.where(F.col("start").isNotNull())
    tiles = F.ceil(F.col("total") / _vectors_at_once(TILE))
    own = F.floor((F.col("place") - F.col("start")) * tiles / F.col("total"))
    dealt = crossing.select("*", own.alias("own"), F.explode(F.sequence(zero, tiles - 1)).alias("other"))
    in_tiles = dealt.select(
        *in_runs.columns[:3],
        F.least("own", "other").alias("low"),
        "place",
        "run",
        F.lit(None).cast("binary").alias("front"),
        "node",
        F.greatest("own", "other").alias("high"),
        "own",
    )
    tasks = in_runs.unionByName(in_tiles).join(nodes.select("node", "raw"), "node")
    return tasks.groupBy(*by, "start", "low", "high").applyInPandas(
        _connected(threshold, kind), "a string, b string"
    )


def _count_links(threshold: float, kind: str):
    """Of two blocks of a component, or one: the links of each vector to the other block."""

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        left, right = frame[frame["own"] == low], frame[frame["own"] == high]
        near = _matrix(left, kind) @ _matrix(right, kind).T >= threshold
        if low == high:
            np.fill_diagonal(near, False)
        sums = [(left, near @ right["copies"].to_numpy())]
        if low != high:
            sums.append((right, near.T @ left["copies"].to_numpy()))
        return pd.concat([pd.DataFrame({"node": f["node"], "links": n}) for f, n in sums])

    return compare


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    miss: float = 1e-6,
    seed: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``. A link that
    is alone between two components is found but for a chance of at most ``miss``."""
    kind = _precision(vectors, vec_col)
    rows = written(_units(vectors, id_col, vec_col), "units")
    valid = rows.where(F.col("node").isNotNull())
    nodes = written(
        valid.groupBy("node").agg(
            F.first("dim").alias("dim"),
            F.first("raw").alias("raw"),
            F.count("*").alias("copies"),
            F.min("id").alias("least"),
        ),
        "nodes",
    )
    linked = written(components(_links(nodes, kind, threshold, miss, seed), "vectors"), "roots")
    members = linked.join(nodes.select("node", "least"), "node")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    # Links inside components, block by block.
    one = linked.withColumn("one", F.lit(1).cast("long"))
    placed = ranked(one, ["root"], ["node"], ["one"], "members")
    own = F.floor(F.col("one_before") / BLOCK)
    last = F.floor((F.col("one_total") - 1) / BLOCK)
    placed = placed.select(
        "root", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    )
    pairs = placed.select(
        "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node"
    ).join(nodes.select("node", "raw", "copies"), "node")
    counted = pairs.groupBy("root", "low", "high").applyInPandas(
        _count_links(threshold, kind), "node string, links long"
    )
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    found = (
        nodes.select("node", "copies", "least")
        .join(linked, "node", "left")
        .join(least, "root", "left")
        .join(links, "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    joined = rows.select("id", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
