import pytest

SF = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated
    rows, and extra columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4),
        (4, long, "en", "a", len(long)), (5, long + " tail", "en", "a", len(long) + 5),
        (6, "one two", "en", None, 7), (6, "one two", "en", None, 7), (7, "one two", "en", "b", 7),
        (8, "Same line\nother line " + passage, "en", "b", 0), (9, "same line\nnew " + passage + " end", "en", "b", 0),
        (None, "text without an id, long enough to be a shingle", "en", "c", 1), (10, "日本 🙂 " * 40, "ja", "c", 1),
        (11, "x", "en", "c", 1), (12, "a " * 300, "en", "c", 1), (13, "a " * 300 + "b", "en", "c", 1),
    ]
    extra = ("row", "size", "shard", "slot", "score", "predicted", "n_lines", "n_dropped", "fp", "bucket", "token", "sid",
             "gid", "key", "d", "x", "u", "length", "kind", "digest", "host", "line", "_text", "component_id")
    df = spark.createDataFrame(rows, BASE)
    for c in extra:
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], BASE)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
