import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, one-word and very long texts, repeated rows, clashing extra columns."""
    rows = [
        (1, None, "en", "s", 1, 0.5, 3), (2, "", None, "s", 0, None, 3), (3, " \t\n ", "de", None, 3, 0.1, None),
        (4, "one", "en", "s", None, 0.2, 3), (None, "one two three four five six seven", "en", "s", 3, 0.2, 3),
        (6, LONG, "en", "s", 5, 0.2, 3), (7, LONG, "en", "s", 5, 0.2, 3), (8, "one two three four five six seven", "fr", "s", 3, 0.2, 3),
        (8, "one two three four five six seven", "fr", "s", 3, 0.2, 3), (9, "\x00 <s> 日本 🙂 ▁ x", "es", "s", 3, 0.2, 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
