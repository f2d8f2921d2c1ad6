"""Objects by path (S3, S10): write, read and check files by their content."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import ship_package


def write_objects(objects: DataFrame, folder: str) -> int:
    """One file per row of (rel_path, content) below ``folder``; a task that is
    tried again writes the same files again. The number of files."""
    ship_package(objects.sparkSession)

    def write(batches):
        from pyarrow import fs as pafs
        fs, base = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for rel, content in zip(pdf["rel_path"], pdf["content"]):
                path = f"{base}/{rel}"
                fs.create_dir(os.path.dirname(path), recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})
    return objects.select("rel_path", F.col("content").cast("binary").alias("content")).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_objects(spark: SparkSession, folder: str, glob: str = "*", digest: bool = True) -> DataFrame:
    """(rel_path, size, content_sha256) of the files below ``folder``. Contents
    are digested where they are read and go no further; without ``digest``
    they are not read at all. A file that cannot be read is not listed."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                  .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder))
    mark = "/" + os.path.basename(folder.rstrip("/")) + "/"
    rel = F.expr(f"substring(path, locate('{mark}', path) + {len(mark)})")
    return files.select(rel.alias("rel_path"), F.col("length").alias("size"), *([F.sha2("content", 256).alias("content_sha256")] if digest else []))


def check_objects(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """S3: every entry of ``manifest`` (rel_path, size, content_sha256, ...)
    with ``state``: ``ok``, ``missing`` (or unreadable), ``size_differs`` or
    ``digest_differs``. An entry without a size or digest is not held to it."""
    f = found.select("rel_path", F.col("size").alias("found_size"), F.col("content_sha256").alias("found_sha256"))
    state = (F.when(F.col("found_size").isNull(), "missing").when(F.col("size") != F.col("found_size"), "size_differs")
              .when(F.col("content_sha256") != F.col("found_sha256"), "digest_differs").otherwise("ok"))
    return manifest.join(f, "rel_path", "left").withColumn("state", state)


def sheet_scan(spark: SparkSession, folder: str, suffix: str = ".sheet.svg") -> DataFrame:
    """The rendered sheets below ``folder``: key (the name before the
    suffix) and size; unreadable files are skipped."""
    sheets = read_objects(spark, folder, f"*{suffix}", digest=False)
    return sheets.select(F.expr(f"substring_index(left(rel_path, length(rel_path) - {len(suffix)}), '/', -1)").alias("key"), "size")
