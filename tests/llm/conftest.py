import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    lines = "\n".join(f"line {i} of a long text" for i in range(3000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Same words here", "en", "a", 1), (3, "same WORDS here", None, "b", 1), (4, "Same words here", "en", "a", 1), (4, "Same words here", "en", "a", 1), (5, lines, "en", "a", 9), (6, "é  <|endoftext|> 日本\r\n\x00", "fr", "a", 3), (7, "1234 !!", "fr", "a", 3)]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", length long, digest string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
