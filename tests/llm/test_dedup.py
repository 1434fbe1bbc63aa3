"""Exact and near-duplicate documents and vectors against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from devicepulse.llm import exact_dedup, minhash, vectors
from devicepulse.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def roots(nodes, links):
    """Least reachable node for each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_links(sets):
    seen, links = defaultdict(list), []
    for i, items in sets.items():
        shared = Counter(j for s in items for j in seen[s])
        links += [
            (i, j)
            for j, n in shared.items()
            if 100 * n >= 75 * (len(items) + len(sets[j]) - n)
        ]
        for s in items:
            seen[s].append(i)
    return links


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, n) for n in range(101, 160)]
    df = spark.createDataFrame(path + star + [(7, 7), (3, 2)], "a long, b long")
    found = {r.node: r.root for r in components(df, "test").collect()}
    assert {found[n] for n in range(41)} == {found[0]}
    assert {found[n] for n in range(100, 160)} == {found[100]} != {found[0]}
    assert components(df.limit(0), "test").count() == 0


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = exact_dedup.decisions(odd).collect()
    assert len(rows) == odd.count()
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in rows})
    small = [r for r in rows if r.doc_id in (1, 2)]
    assert {(r.keep_id, r.group_size) for r in small} == {(2, 3)}
    assert {r.keep_id for r in rows if r.doc_id in (3, 4)} == {4}
    stays = exact_dedup.survivors(odd)
    assert stays.columns == odd.columns
    assert sorted(str(r.doc_id) for r in stays.collect()) == sorted(
        str(r.doc_id) for r in rows if r.kept
    )
    assert exact_dedup.decisions(empty).count() == 0 == exact_dedup.survivors(empty).count()


def test_exact_dedup_of_one_hot_text(spark):
    df = spark.range(0, 3000, 1, 12).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'Hot', concat('t', id)) AS text"
    )
    rows = exact_dedup.decisions(df).collect()
    hot = [r for r in rows if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2997, 1000)}
    assert sum(r.kept for r in rows) == 2001 == exact_dedup.survivors(df).count()


def test_minhash_is_brute_force_on_documents(documents):
    sets = {r.doc_id: shingle_set(r.text) for r in documents.collect()}
    expected = roots(sets, brute_links(sets))
    found = minhash.near_duplicates(documents).collect()
    assert len(found) == len(sets)
    for r in found:
        wanted = (len(sets[r.doc_id]), expected[r.doc_id], r.doc_id == expected[r.doc_id])
        assert (r.n_shingles, r.component_id, r.kept) == wanted
    stays = minhash.one_of_each(documents)
    assert {r.doc_id for r in stays.collect()} == {r.doc_id for r in found if r.kept}


def test_minhash_of_a_borderline_cluster(spark):
    """Many copies with edits, whose similarities lie around the threshold."""
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(90):
        words = list(base)
        for at in draw.choice(150, 3, replace=False):
            words[at] = f"e{i}x{at}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in texts.items()}
    expected = roots(sets, brute_links(sets))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert found == expected


def test_minhash_of_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].n_shingles for i in (3, 4, 5)} == {0}
    assert all(by_id[i].kept for i in (3, 4, 5, 7, 8))
    assert by_id[2].component_id == 1 == by_id[1].component_id and by_id[7].n_shingles == 1
    stays = minhash.one_of_each(odd)
    assert stays.columns == odd.columns
    found = Counter(r.doc_id for r in stays.collect())
    assert found == Counter({i: 1 for i in (1, 3, 4, None, 5, 6, 7, 8)})
    assert minhash.near_duplicates(empty).count() == 0 == minhash.one_of_each(empty).count()


def test_bayes_table_keeps_what_it_should():
    """At the threshold a pair is given up with little more than the miss probability."""
    assert minhash.NEEDED == sorted(minhash.NEEDED)
    draw = np.random.default_rng(2)
    same = draw.random((20_000, minhash.HASHES)) < 0.8
    left = np.zeros((20_000, minhash.HASHES), np.uint8)
    assert minhash.promising(left, np.where(same, 0, 1).astype(np.uint8)).all()
    far = draw.random((20_000, minhash.HASHES)) < 0.3
    assert minhash.promising(left, np.where(far, 0, 1).astype(np.uint8)).mean() < 0.001


def brute_vectors(rows, threshold=0.95):
    units = {}
    for i, v in rows:
        v = np.array([math.nan if x is None else x for x in v], float) if v else np.zeros(0)
        size = math.sqrt((v * v).sum())
        if len(v) and np.isfinite(size) and size > 0:
            units[i] = v / size
    links = [
        (a, b)
        for a in units
        for b in units
        if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    ]
    return roots([i for i, _ in rows], links), Counter(i for pair in links for i in pair)


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 24))
    rows = []
    for i in range(700):
        centre = centres[0] if i % 3 == 0 else centres[i % 40]
        rows.append((i, (centre + 0.12 * draw.standard_normal(24)).tolist()))
    rows += [(700 + i, rows[5][1]) for i in range(30)]
    rows += [(800, None), (801, []), (802, [0.0] * 24), (803, [1.0, None] * 12)]
    rows += [(804, [math.inf] + [1.0] * 23), (805, [1.0] * 8), (806, [1e300] * 24), (807, [3e-300] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    component, links = brute_vectors(rows)
    component[807], links[806], links[807] = 806, 1, 1  # their squares overflow above
    # Columns with clashing names are ignored; rows that share an id are copies.
    extra = ("node", "raw", "pass", "front", "place", "copies", "root", "n_links")
    found = vectors.near_vectors(df.select("*", *[F.lit("x").alias(c) for c in extra])).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: r.n_links for r in found} == {i: links[i] for i, _ in rows}
    assert {r.vec_id: r.component_id for r in found} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("size", [0, 1])
def test_vectors_of_tiny_tables(spark, size):
    df = spark.createDataFrame([(None, [1.0, 2.0])][:size], "vec_id long, embedding array<double>")
    rows = vectors.near_vectors(df).collect()
    assert [tuple(r) for r in rows] == [(None, 0, None, True)][:size]


def hot_cone(n, planted, seed=1, dim=64):
    """Unit vectors in one cone of pairwise cosine about 0.85; the first ``planted`` have
    a near one each, at cosine 0.952 to 0.96, as the last ``planted``."""
    draw = np.random.default_rng(seed)

    def away(v):
        d = draw.standard_normal(v.shape)
        d -= (d * v).sum(1, keepdims=True) * v
        return d / np.linalg.norm(d, axis=1, keepdims=True)

    axis = np.tile(np.eye(dim)[0], (n - planted, 1))
    cone = np.sqrt(0.85) * axis + np.sqrt(0.15) * away(axis)
    near = draw.uniform(0.952, 0.96, (planted, 1))
    first = cone[:planted]
    return np.vstack([cone, near * first + np.sqrt(1 - near**2) * away(first)])


def check_links(spark, units):
    links, ends = np.zeros(len(units), int), []
    for i in range(0, len(units), 2_000):
        near = units[i : i + 2_000] @ units.T >= 0.95
        a, b = near.nonzero()
        a = a + i
        links += np.bincount(a[a != b], minlength=len(units))
        ends += zip(a[a < b].tolist(), b[a < b].tolist())
    frame = pd.DataFrame({"vec_id": range(len(units)), "embedding": units.tolist()})
    df = spark.createDataFrame(frame, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert [found[i].n_links for i in range(len(units))] == links.tolist()
    component = roots(range(len(units)), ends)
    assert {i: r.component_id for i, r in found.items()} == component


def test_vectors_of_a_hot_cone(spark):
    check_links(spark, hot_cone(9_000, 1_500))


def test_vectors_of_stretches_over_many_runs(spark, monkeypatch):
    """Narrow windows, runs and tiles: most links cross a boundary of all three."""
    for name, value in (("WINDOW", 16), ("RUN", 40), ("TILE", 100), ("BLOCK", 24)):
        monkeypatch.setattr(vectors, name, value)
    cells = vectors.Cells(4 * math.sqrt(0.1), 3, 25)
    assert (1 - vectors._together(4) ** 3) ** 25 < 1e-6
    monkeypatch.setattr(vectors, "_plans", lambda *_: {64: cells})
    check_links(spark, hot_cone(1_500, 300))
    # One stretch alone finds all links, as its tiles are compared with each other.
    monkeypatch.setattr(vectors, "_plans", lambda *_: {})
    check_links(spark, hot_cone(700, 200))


def test_single_precision_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.3, 0.4]), (3, [6.0, 8.0]), (4, [-3.0, 4.0]), (5, [3.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_pairs_at_the_threshold():
    """Pairs nearer to the threshold than single precision can tell are decided in double."""
    left = hot_cone(300, 0)
    right = 0.95 * left + math.sqrt(1 - 0.95**2) * np.roll(left, 1, 0)
    right /= np.linalg.norm(right, axis=1, keepdims=True)
    exact = (left[:, None, :] * right[None, :, :]).sum(axis=2)
    for threshold in (0.95, float(np.median(exact)), float(exact[3, 3])):
        found = set(zip(*(x.tolist() for x in vectors._near(left, right, threshold))))
        assert found == set(zip(*(x.tolist() for x in (exact >= threshold).nonzero())))


def test_sorted_keys():
    """Bytes of the keys sort like the hashes."""
    cells = np.array([[-3, 5], [-3, -1], [1 << 40, 0], [0, 0], [-(1 << 40), 9]])
    order = sorted(range(5), key=lambda i: vectors._sortable(cells)[i])
    assert order == [4, 1, 0, 3, 2]


def test_cells_of_a_sample():
    units = hot_cone(vectors.SAMPLE, 0)
    for n in (1_000, 60_000, 60_000_000):
        cells = vectors.cheapest(units, n, 0.95, 1e-6)
        assert cells.number > 0 < cells.passes
        kept = vectors._together(cells.width / math.sqrt(0.1)) ** cells.number
        assert (1 - kept) ** cells.passes < 1.1e-6
    draw = np.random.default_rng(2)
    kept = np.zeros(2)
    for i in range(4_000):
        pair = np.vstack([np.zeros(64), np.eye(64)[0] * math.sqrt(0.1)])
        c = vectors._cells(pair, cells.width, 1, draw)
        kept += [1, c[0, 0] == c[1, 0]]
    assert abs(kept[1] / kept[0] - vectors._together(cells.width / math.sqrt(0.1))) < 0.03
