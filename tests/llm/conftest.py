"""Tables that no operator may trip over."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} runs{k % 31}" for k in range(30_000)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank and very long texts, repeated rows, ties, letters of many scripts."""
    plain = "the cat sat on the mat and looked at the dog that ran over the hill in the rain for an hour or two"
    return [
        (1, plain, "en", "a", len(plain)),
        (1, plain, "en", "a", len(plain)),
        (2, plain, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", "b", 0),
        (5, " \t\n\v\f\r ", "de", "b", 7),
        (None, plain, "fr", "c", 1),
        (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)),
        (7, "x" * 100_000, "en", "a", 100_000),
        (8, "1 " * 20_000, "en", "a", 40_000),
        (9, "日本語 Ελληνικά Σίσυφος İstanbul \x1c á \U0001f600 <|endoftext|>", "el", "d", 9),
        (10, "one", "en", "a", 3),
        (-5, "a@b.co, +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", "en", "a", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def crowded(spark, odd):
    """The same with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("kept", "score", "start", "ids", "key", "id", "component", "__measures", "__hits", "__pii", "a.b", "label", "length", "rank")
    return odd.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a scale-factor folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
