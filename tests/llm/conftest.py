import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


#: Nulls in any column, empty and repeated rows, ties, a long text, and columns whose names clash with results.
ROWS = [
    (0, "one two three.\nfour five", "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one two three.\nfour five", "de", "b"),
    (3, "one two three.\nfour five", "de", "b"),
    (None, "x", "en", "c"),
    (5, "w " * 30000, "en", "c"),
    (6, "é😀 \t naïve\n\nsecond section\nhere", "fr", None),
    (7, "solo", "fr", "z"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, 0, 0, "kept", 0) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept string, shard int").repartition(3)
