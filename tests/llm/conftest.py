from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox " * 6000


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with internal names."""
    rows = [
        (1, "Hello  world again", "en", "s"), (2, "Helloworldagain", "en", "s"), (3, None, None, None), (4, "", "en", None),
        (5, " \n\t", None, "s"), (None, "Hello world again", "en", "s"), (7, LONG, "en", "s"), (8, LONG + "!", "en", "s"),
        (9, "Éa ß — ﬁ İ ſ K 漢字", "xx", "s"), (9, "Éa ß — ﬁ İ ſ K 漢字", "xx", "s"), (10, "12345 !!", "de", "s"), (None, None, None, None),
        (11, "one", "en", "s"), (12, "one two", "en", "s"),
    ]
    rows = [(*r, len(r[1] or ""), "x", "y", 1, "z") for r in rows]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, spans string, print int, kept_id string"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
