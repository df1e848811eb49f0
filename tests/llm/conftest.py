import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names."""
    word = [f"w{i}x" for i in range(400)]
    long_line = " ".join(word)
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 3), (None, "lonely row without id here", "en", "b", 1),
        (4, "one", "en", "a", 3), (5, long_line, "en", "a", 1), (6, long_line, "en", None, 1), (7, long_line + " more", "en", "b", 1),
        (7, long_line + " more", "en", "b", 1), (8, "x\n" * 40 + " ".join(word[:30]), "en", "b", 1),
        (9, " ".join(word[50:150]) + "\n" + " ".join(reversed(word[200:300])), "en", "c", 1),
        (10, " ".join(["again"] * 5000), "en", "c", 1), (11, "\U0001F600 été   " + " ".join(word[:60]), "en", "c", 1),
        (11, "second row under the same id " + " ".join(word[100:160]), "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("kept", "n_words", "_row", "fp", "h", "id", "t", "key", "n"):
        df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
