import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    from pathlib import Path

    if not Path(DATA).is_dir():
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, ties, a very long text, characters beyond the basic plane, and extra columns
    whose names clash with those that operators make."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two", "b"), (4, "one two", "b"), (4, "another text of this id", "b"), (None, "no id here at all", "b"), (None, None, None), (5, long, "c"), (6, long + " end", "c"), (7, "é𝒳 Ünï 文字 token=abcdef12", "a"), (8, "x", ""), (9, "x", "")]
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 0, 0.5, "k", 1) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, size int, score double, key string, part int")
