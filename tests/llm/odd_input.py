"""Tables of odd rows, shared by the tests of this folder."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns named like results."""
    long_text = " ".join(f"Wort{i % 977} the and {i}" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "de", None), (4, "%%% ### 12 34", "en", ""), (5, long_text, "en", "a"),
        (6, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
        (7, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "b"),
        (8, "The quick brown fox jumps over the lazy dog near the river bank today", None, None),
        (8, "The quick brown fox jumps over the lazy dog near the river bank today", None, None),
        (9, "É è ü", "fr", "Z"), (10, "one two", "en", "Z"), (10, "three four", "en", "Z"), (None, "no id here", "en", "c"), (11, "É È Ü", "fr", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ("score", "kept", "keep_id", "size", "target", "taken", "copies", "n_tokens", "words", "h", "key", "node", "band", "component", "batch", "row", "train", "_train", "block")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
