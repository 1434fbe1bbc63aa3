"""Small odd tables for all operators."""

from __future__ import annotations

import pytest

ODD = [
    (1, "A small text, with seven words here.", "en", "a"),
    (2, "a SMALL text, with seven words here.", "en", "a"),
    (2, "a SMALL text, with seven words here.", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (None, "No id here, but some words to read.", "en", "b"),
    (5, "   \n\t ", "en", "b"),
    (6, "één twee drie vier vijf zes ſ K zeven", "nl", "c"),
    (7, "word " * 30_000, "en", "a"),
    (8, "x" * 200_000, "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and very long texts, repeated rows and columns named like internals."""
    rows = [(*r, 1, "x", 2, "y", 3.0) for r in ODD]
    names = "doc_id long, text string, lang string, source string, digest int, salt string, "
    return spark.createDataFrame(rows, names + "node int, row string, tokens double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
