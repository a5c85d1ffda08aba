import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    line = "one two three four five six seven eight nine ten eleven twelve."
    rows = [(1, line, "en", "a", 1), (1, line, "en", "a", 1), (2, line, None, None, None), (3, None, "en", "a", None),
            (4, "", "de", "b", 0), (None, line + " x", "en", None, 3), (5, " \t\n", None, "b", 3),
            (6, "mail jo.1@mail.example.com 4111 1111 1111 1111 " + line, "en", "a", 9), (7, "wörd\u2003ß 🙂 " * 4000, "de", "b", 9),
            (8, "a" * 50_000, "en", "a", 9), (9, ("abc " * 12 + "\n") * 3000, "en", "c", 9), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those that the operators make."""
    names = ["fingerprint", "component_id", "shard", "kind", "counts", "judgement", "size", "rows", "copies", "target", "ids",
             "match", "key", "pii_matches", "mix_id", "limit_lang", "n_words", "family", "Digest", "body"]
    return docs.select("*", *[F.lit(7).alias(n) for n in names])
