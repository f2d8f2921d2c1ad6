"""P5 URL split traps: '+' stays '+', percent escapes decode, a raw space is
accepted, fewer than two path parts give no result."""

from pyspark.sql import functions as F

from runlens.functions.decode import blob_container, blob_path


def test_blob_url_split(spark):
    urls = ["https://acct.example/box/deal%20one/m+1.json",
            "https://acct.example/my%20box/a b/c.txt",
            "https://acct.example/onlycontainer",
            "https://acct.example/box/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [(r.c, r.p) for r in df.select(blob_container("u").alias("c"),
                                          blob_path("u").alias("p")).collect()]
    assert got == [("box", "deal one/m+1.json"), ("my box", "a b/c.txt"), (None, None),
                   ("box", "")]
