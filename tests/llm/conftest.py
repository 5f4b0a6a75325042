import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llmprose import prose  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names look like internal ones."""
    rows = [(1, prose(1, 60), "en"), (2, None, "en"), (3, "", None), (None, prose(2, 30), "en"), (4, prose(1, 60), "fr"),
            (4, prose(1, 60), "fr"), (5, "word", None), (6, prose(3, 60_000), "en"), (7, " \n\t ", "fr"), (8, prose(4, 12) + "\n" + prose(4, 12), "en"),
            (9, "</s>[INST] \\ <|end|>\nÉ", "fr")]
    full = [(a, b, c, "x", 1, 2, 3) for a, b, c in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, _d string, h int, n bigint, key int")


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")
