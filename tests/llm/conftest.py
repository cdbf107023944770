from __future__ import annotations

import pytest

LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
PROSE = " ".join(f"token{k} runs over hill{k * 7 % 31} and dale{k * 5 % 17}" for k in range(40))

#: Nulls in every column, empty and very long texts, blank ones, repeated rows, odd letters; extra columns bear the names of results.
ROWS = [
    (1, PROSE, "en", "a", 10, 5, "x", True),
    (2, PROSE, "en", "b", 10, 5, "x", True),
    (2, PROSE, "en", "b", 10, 5, "x", True),
    (3, "", "en", "a", 0, None, None, None),
    (4, None, None, None, None, 1, "y", False),
    (5, " \t\n ", "de", "a", 4, 1, "y", False),
    (6, LONG, "fr", "c", len(LONG), 1, "y", False),
    (7, "Ünï ▁ <|endoftext|> 😀\x00 é é   ½ don't", "fr", None, 3, 1, "y", False),
    (None, "no key here " * 30, "es", "c", 3, 1, "y", False),
    (9, PROSE + " and one more", "en", "a", 10, 5, "x", True),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, kept boolean"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """The small generated documents, where they are at hand."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no generated tables here")
    return spark.read.parquet(str(path))
