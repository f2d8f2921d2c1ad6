"""Operator 10: site-relative line deduplication.

Group by host, divide the pages that contain a line by the host's pages, and
drop the lines whose share exceeds a boilerplate ratio. Pages are distinct
texts: copies of a page are one, so that they do not make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.005      # a line on more than this share of its host's pages is boilerplate
MIN_PAGES = 3      # ... and on at least this many of them
BROADCAST_LINES = 100_000  # boilerplate lines up to which the set is sent to every task


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines.

    A line is trimmed of spaces; blank lines never count. It counts once a
    distinct text, told by its hash; null texts are no page. A host keeps at
    most (lines per page / ratio) such lines.
    """
    seen = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("u"), F.explode(F.expr(
        f"array_distinct(transform(filter(transform(split(`{text}`, '\\n'), l -> trim(l)), l -> l <> ''), l -> xxhash64(l)))"
    )).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count_distinct("u").alias("n")).filter(F.col("n") >= min_pages)
    pages = docs.filter(F.col(text).isNotNull()).groupBy(F.col(host).alias("h")).agg(F.count_distinct(F.xxhash64(text)).alias("pages"))
    return (counts.join(pages, F.col("host").eqNullSafe(F.col("h")))
                  .filter(F.col("n") > ratio * F.col("pages"))
                  .groupBy("host").agg(F.collect_set("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                     ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host cut from
    ``text``, and ``n_lines`` / ``n_dropped`` (non-blank lines, and those cut).

    Every row is a page, but equal texts of a host count once; equal rows get
    equal results. A null host is a host of its own. A null text has no lines and
    stays null; an empty one stays empty; a page of boilerplate only becomes
    empty but stays. Columns of the input named like the outputs are replaced.
    """
    sets = boilerplate(docs, host, text, ratio, min_pages)
    known = sets.select(F.col("host").alias("_host"), F.col("lines").alias("_lines")).persist()
    lines = known.agg(F.sum(F.size("_lines"))).first()[0] or 0
    side = F.broadcast(known) if lines <= BROADCAST_LINES else known
    blank = "filter(split(_text, '\\n'), l -> trim(l) <> '')"
    cut = "filter(split(_text, '\\n'), l -> trim(l) = '' OR NOT array_contains(_lines, xxhash64(trim(l))))"
    n = F.expr(f"coalesce(size({blank}), 0)")
    joined = (docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
                          F.col(host).alias("_h"), F.col(text).alias("_text"))
                  .join(side, F.col("_h").eqNullSafe(F.col("_host")), "left"))
    out = joined.withColumn("_cut", F.when(F.col("_lines").isNull(), F.expr("split(_text, '\\n')")).otherwise(F.expr(cut)))
    kept = F.expr("coalesce(size(filter(_cut, l -> trim(l) <> '')), 0)")
    new = {text: F.array_join("_cut", "\n")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c)
                        for c in docs.columns if c not in ("n_lines", "n_dropped")],
                      F.greatest(n, F.lit(0)).cast("int").alias("n_lines"),
                      (F.greatest(n, F.lit(0)) - F.greatest(kept, F.lit(0))).cast("int").alias("n_dropped"))
