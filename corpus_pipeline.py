"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and is written as Parquet and read again before the next one. All but
the last return the columns of ``documents``; where a text changes, so does
``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from runlens.llm.common import scratch, staged
from runlens.llm.queries import held_out, tokenizer_path
from runlens.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return quality.score_quality(docs.select(*COLUMNS), labels).filter("predicted = 1").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of the documents' sources are cut; every
    document stays."""
    cut = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows the one with the smallest id stays (a null id counts as
    the largest; of rows with one id, one). Rows are numbered, as ids may
    repeat or be null, and written with their numbers."""
    rows = staged(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = (jaccard_join.jaccard_components(rows.select("row", "text"), doc_id="row")
              .select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = (rows.select("row", "doc_id").join(groups, "row").groupBy("component").agg(F.min(first).alias("first"))
                .select(F.col("first.row").alias("stays")))
    return rows.join(kept, F.col("row") == F.col("stays"), "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.without_items(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their place in the sequences."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality classifier", good_quality), ("line dedup", without_boilerplate),
          ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", without_benchmark),
          ("best-fit packing", packed)]

#: A learned score, an exact similarity join's components and a tokenizer are
#: not SQL; tests/llm checks every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
