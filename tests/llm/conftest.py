import pytest

DATA = "/root/testdata"

#: Null ids and texts, blanks, repeated rows, ties, and a long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today.\nSecond line of the very first text here.", "en", 7),
    (2, "the quick brown fox jumps over the lazy dog today\nAnother line that nobody else has in here.", "en", 7),
    (3, None, None, None),
    (4, "", "en", 7),
    (5, " \n\t \n", "en", 7),
    (6, "one two", "en", 7),
    (7, "one two", "en", 7),
    (7, "one two", "en", 7),
    (None, "The quick brown fox jumps over the lazy dog today.", "en", 7),
    (8, "word " * 30000, "en", 7),
    (9, "ünï ĉødé 漢字 текст 😀 " * 9, "en", 7),
]
SCHEMA = "doc_id long, text string, lang string, __id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with an extra column whose name the operators use inside."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
