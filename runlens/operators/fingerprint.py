"""A1 content fingerprint and J1 unchanged-since-last-run check.

The reference keys a deal's documents by SHA-256 over the newline-joined
sorted artifact hashes (duplicates kept, a missing hash counts as ''). Over
a manifest *document* that is a per-row expression (``manifest_key``). Over
a flat artifact table the same ordered concatenation would force every
artifact of a deal through one task, so ``fingerprints`` uses a mergeable
multiset digest instead: count plus four 60-bit sums of per-artifact
SHA-256 values, hashed once more. Equal multisets of hashes give equal keys
and any change gives a different key (collision odds ~2^-200), so every
skip/compile decision is the reference's; only the key text differs, and
it is computed with partial aggregation whatever the size of one deal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import blank_to_null


def manifest_key(hashes: Column) -> Column:
    """Exact reference key of one manifest row's ``array<string>`` of hashes."""
    return F.sha2(F.array_join(F.array_sort(
        F.transform(hashes, lambda h: F.coalesce(h, F.lit("")))), "\n"), 256)


def _segment(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")


def fingerprints(artifacts: DataFrame, key: str = "deal_id",
                 hash_col: str = "content_sha256") -> DataFrame:
    """One row per deal: ``n_artifacts`` and the mergeable ``artifact_key``."""
    h = F.sha2(F.coalesce(F.col(hash_col), F.lit("")), 256)
    per = artifacts.select(key, *[_segment(h, i).alias(f"s{i}") for i in range(4)])
    agg = per.groupBy(key).agg(F.count(F.lit(1)).alias("n_artifacts"),
                               *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)])
    digest = F.concat_ws(":", F.col("n_artifacts").cast("string"),
                         *[F.col(f"s{i}").cast("string") for i in range(4)])
    return agg.select(key, "n_artifacts", F.sha2(digest, 256).alias("artifact_key"))


def unchanged_jobs(current: DataFrame, stored: DataFrame,
                   key: str = "deal_id") -> DataFrame:
    """A job is redundant iff a record exists, its artifact key equals the
    current one and its scope equals the current scope (null equals null);
    ``force`` bypasses the check; no record means compile.

    ``current``: key, artifact_key, as_of, force. ``stored``: key,
    artifact_key, as_of. Left join on the key; the stored side has one row
    per deal, so a hot deal does not multiply rows.
    """
    s = stored.select(key, F.col("artifact_key").alias("stored_key"),
                      blank_to_null("as_of").alias("stored_as_of"),
                      F.lit(True).alias("has_record"))
    j = current.withColumn("as_of", blank_to_null("as_of")).join(s, key, "left")
    same = (F.col("has_record").isNotNull()
            & (F.col("stored_key") == F.col("artifact_key"))
            & F.col("stored_as_of").eqNullSafe(F.col("as_of")))
    unchanged = F.coalesce(same, F.lit(False))
    return j.select(
        key, "artifact_key", "as_of", "stored_key", "stored_as_of",
        F.coalesce("has_record", F.lit(False)).alias("has_record"),
        F.col("force").cast("boolean").alias("force"),
        unchanged.alias("unchanged"),
        F.when(~F.col("force") & unchanged, "skip_unchanged").otherwise("compile")
         .alias("decision"))


def resolve_artifacts(artifacts: DataFrame) -> DataFrame:
    """source = blob_url or url, name = filename or path or name (empty
    counts as missing); entries lacking either are skipped; leading '/' and
    then leading '\\' are stripped from the name."""
    src = F.coalesce(F.nullif(F.col("blob_url"), F.lit("")), F.nullif(F.col("url"), F.lit("")))
    rel = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("filename", "path", "name")])
    return (artifacts.select("deal_id", "pos", src.alias("source_url"), rel.alias("_rel"),
                             "content_sha256")
            .where(F.col("source_url").isNotNull() & F.col("_rel").isNotNull())
            .select("deal_id", "pos", "source_url",
                    F.ltrim(F.ltrim(F.col("_rel"), F.lit("/")), F.lit("\\")).alias("rel_path"),
                    "content_sha256"))
