import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [
        (1, "alpha beta gamma delta epsilon\nsame line", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "alpha beta gamma delta epsilon\nsame line", "en", "b", 5),
        (4, "alpha beta gamma delta epsilon\nsame line", "en", "b", 5), (None, "no id here", "de", "b", 10), (5, "word " * 30_000, "fr", "c", 150_000), (6, " \t\n ", "fr", None, 4), (7, "é'Σ<|endoftext|>日本 x", "xx", "c", 9),
    ]
    clash = "kept string, keep_id string, shard string, size string, draws string, threshold string, n_lines string, _key string, gram string, epoch string"
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{DOCS}, {clash}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
