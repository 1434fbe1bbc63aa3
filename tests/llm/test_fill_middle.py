"""Fill-in-middle: skip list, round trip, shares and odd rows. The query has check SQL."""

from __future__ import annotations

import re
from itertools import accumulate

import pytest

from devicepulse.llm import fill_middle as fim


@pytest.mark.parametrize("n", [0, 1, 2, 5, 63, 1_000, 20_000])
def test_skip_list(n):
    points = [(i * 7) % 11 for i in range(n)]
    index = fim.SkipList(points)
    before = [0, *accumulate(points)]
    for rank in {*range(0, n + 1, max(1, n // 97)), n}:
        assert index.reach(rank) == before[rank]
    for (units, points_, _), (below, _, _) in zip(index.lanes[1:], index.lanes):
        assert sum(units) == n and sum(points_) == before[-1] and len(units) < len(below)
    if n > 100:
        assert len(index.lanes) > 2 and len(index.lanes[-1][0]) < 60


@pytest.mark.parametrize("text", ["", "\n", "a", "a\nb", "a\n\n", "\r\n\x85é b\nc"])
def test_lines(text):
    assert fim.lines(text) == re.findall(r"[^\n]*\n|[^\n]+", text)


def test_round_trip_of_odd_rows(odd, empty):
    rows = fim.fill_in_middle(odd).select("*", fim.restore("output", "form").alias("back")).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert r.back == texts[r.doc_id]
        assert (r.form == "plain") == (not r.back) == (r.prefix_chars is None)
        assert r.n == len(re.findall(r"[^\n]*\n|[^\n]+", r.back))
    assert fim.fill_in_middle(empty).count() == 0


def test_marks_in_texts_and_shares(spark):
    rows = [(f"d{i}", "one\ntwo <S\n>three\n<") for i in range(400)] + [("x", "a<P>\nb"), (None, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    made = fim.fill_in_middle(docs, rate=60, spm=30)
    made = made.select("*", fim.restore("output", "form").alias("back")).collect()
    texts = dict(rows)
    assert all(r.back == texts[r.doc_id] for r in made)
    forms = {r.doc_id: r.form for r in made}
    assert forms["x"] == "plain"
    counts = {f: sum(v == f for v in forms.values()) for f in ("plain", "psm", "spm")}
    assert 120 < counts["plain"] < 200 and 0.2 < counts["spm"] / (counts["spm"] + counts["psm"]) < 0.4
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_parts(spark):
    docs = spark.createDataFrame([(i, "ab\ncdé\n\nf") for i in range(50)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs).collect():
        text = "ab\ncdé\n\nf"
        prefix, middle = text[: r.prefix_chars], text[r.prefix_chars : r.prefix_chars + r.middle_chars]
        suffix = text[r.prefix_chars + r.middle_chars :]
        psm = f"<P>{prefix}<S>{suffix}<M>{middle}"
        assert r.output == (psm if r.form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
        assert prefix == "" or prefix.endswith("\n") or not suffix + middle
