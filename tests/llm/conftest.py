import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from marketlane.llm.queries import prepare  # noqa: E402

SCHEMA = "doc_id long, text string, key string, score double, label int, bucket string"


@pytest.fixture(scope="session")
def session(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def edge_docs(session):
    """Nulls, empty, blank, very long, repeated, special strings; extra columns with names the operators use inside."""
    words = [f"w{i % 97}x{i % 89}" for i in range(30_000)]
    texts = ["Alpha beta, gamma delta epsilon zeta eta theta.", "", None, "   \n\t ", "!!! ???", " ".join(words), "one", "one",
             "Café größe 手机 naïve 'tis they're x<|endoftext|>y", "a" * 5000, "Alpha beta, gamma delta epsilon zeta eta theta."]
    rows = [(i, t, "k", 0.1, 1, "b") for i, t in enumerate(texts)] + [(None, "no id here at all", None, None, None, None), (6, "one", "k", 0.1, 1, "b")]
    return session.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(session):
    return session.createDataFrame([], SCHEMA)
