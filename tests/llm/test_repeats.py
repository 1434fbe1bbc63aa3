"""Suffix order and the removal of repeats, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from devicepulse.llm import repeats
from devicepulse.llm.suffixes import common_prefixes, suffix_order


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        n = rng.integers(1, 200)
        text = np.append(rng.integers(0, letters + 1, n), 0).astype(np.uint8)
        wanted = rng.random(len(text)) < 0.5
        depth = len(text) + 8
        order = suffix_order(text, wanted, depth)
        data = text.tobytes() + bytes(depth)
        keys = [data[i : i + depth] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(np.flatnonzero(wanted))
        shared = common_prefixes(text, order, depth)
        for i in range(1, len(order)):
            same = [a == b for a, b in zip(keys[i - 1], keys[i])]
            assert shared[i] == (same.index(False) if False in same else depth)


def brute(rows, length):
    """Sorted (id, n_bytes, n_removed, n_spans, digest of the rest) by their definition."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    tie = dict(enumerate(texts))
    order = sorted(tie, key=lambda k: (tie[k][0] is not None, tie[k][0] or 0))
    seen, out = set(), []
    for k in order:
        name, text = tie[k]
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - length + 1):
            string = text[at : at + length]
            if string in seen:
                gone[at : at + length] = True
            seen.add(string)
        left = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((name, len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    rows = [
        (
            r[0],
            r.n_bytes,
            sum(s.stop - s.start for s in r.spans),
            len(r.spans),
            hashlib.sha256(bytes(r.kept)).hexdigest(),
        )
        for r in df.collect()
    ]
    return sorted(rows, key=repr)


def test_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    theirs = brute(rows, 100)
    assert found(repeats.without_repeats(documents)) == theirs
    assert sum(r[2] for r in theirs) > 0


def test_query(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    df = repeats.op13(spark, sf_dir)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, df.collect()), key=repr) == brute(rows, 100)


@pytest.mark.parametrize("many, crowd", [(4_096, 64), (2, 1)])
def test_short_strings(spark, monkeypatch, many, crowd):
    """Few letters, so that nearly everything repeats; with and without salted grams."""
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "PIECE", 37)
    monkeypatch.setattr(repeats, "ORDERED", 400)
    rng = np.random.default_rng(7)
    rows = [(i, "".join(rng.choice(list("abé"), rng.integers(0, 90)))) for i in range(60)]
    rows += [(70, "a" * 300), (71, "ab" * 80), (72, "b" + "a" * 299), (73, "\0" * 40), (74, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length in (6, 13):
        assert found(repeats.without_repeats(docs, length)) == brute(rows, length)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(repeats.without_repeats(odd)) == brute(rows, 100)
    assert repeats.without_repeats(empty).count() == 0


def test_repeated_rows_and_other_ids(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [("b", long), ("a", long + "end"), ("b", long), ("b", long), (None, "x" * 120)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.n_bytes, len(r.kept)) for r in repeats.without_repeats(docs).collect()}
    first = brute([(0, rows[-1][1]), (1, rows[1][1]), (2, long), (3, long)], 100)
    kept = {r[0]: r[1] - r[2] for r in first}
    assert kept[2] == kept[3] == 0
    assert got == {("b", 147, 0), ("a", 150, kept[1]), (None, 120, kept[0])}
    assert repeats.without_repeats(docs).count() == 5


def test_a_crowd_of_one_batch_is_ordered_whole(spark, monkeypatch):
    """Near copies crowd a batch with contexts of one gram. While these are not more than
    ``MANY``, no window of theirs is passed on by itself."""
    monkeypatch.setattr(repeats, "CROWD", 2)
    tables = {}

    def seen(df, tag):
        tables[tag] = written(df, tag)
        return tables[tag]

    written = repeats.written
    monkeypatch.setattr(repeats, "written", seen)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 120))
    rows = [(i, text + f"{i:05d}" + text[::-1]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(repeats.without_repeats(docs)) == brute(rows, 100)
    assert tables["repeats"].where("digest IS NOT NULL").count() == 0
    monkeypatch.setattr(repeats, "MANY", 20)
    assert found(repeats.without_repeats(docs)) == brute(rows, 100)
    assert tables["repeats"].where("digest IS NOT NULL").count() > 0
