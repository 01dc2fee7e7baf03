import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, clashing extra columns."""
    base = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank. "
    rows = [
        (1, base * 3, "en", "a", 5),
        (2, base * 3, "en", "a", 5),
        (2, base * 3, "en", "a", 5),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", None, 4),
        (6, " ".join(f"w{i * 7919 % 99991}" for i in range(40_000)), "en", "a", 9),
        (7, "#*$ %% && || <> " * 20, "en", "b", 9),
        (None, base, None, None, None),
        (None, "short text", "fr", "c", 10),
        (8, "é" * 300 + "\0" + "日本語 " * 30, "ja", "c", 1),
        (9, base * 3 + " tail", "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("N_Words", "score", "kept", "hits", "size", "component_id", "removed", "shard", "target", "n", "node", "h"):
        df = df.selectExpr("*", f"'extra' AS `{c}`")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))

