import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import LONG, SF, extra  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, ties, one very long text, clashing columns."""
    rows = [
        (None, "a text without an id " * 4), (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"),
        (6, LONG), (7, LONG + " and a little more"), (8, "É Straße <|endoftext|> it's  fine\x00"), (9, "mail me at a.b@mail.example.com or +1 (555) 555-0199 " * 3), (10, "single"),
    ]
    return extra(spark.createDataFrame(rows, "doc_id long, text string")).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return extra(spark.createDataFrame([], "doc_id long, text string"))


@pytest.fixture(scope="session")
def documents(spark):
    """Id and text of every row of the small documents table, by id."""
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
