import pytest


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [(1, "a b c d e", "en", None), (2, None, None, "s"), (3, "", "en", "s"), (None, "a b c d e", "en", "s"), (5, long_text, "en", "s"), (6, long_text, "en", "s"), (7, "A b c d e", "en", "s"), (7, "A b c d e", "en", "s"), (8, " \t\n", "de", "s"), (9, "é ß ü 日本 ▁ x", "de", "s")]
    return spark.createDataFrame([(d, t, l, s, 1, "x", "y") for d, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
