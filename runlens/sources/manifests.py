"""Manifest documents (S2, P8, A1): one JSON document per file, read whole.

A document's core is typed, the rest stays open: it is parsed once into a
VARIANT, its ``artifacts`` are exploded with their positions, and a document
that cannot be read is told with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.decode import is_object, vtype
from runlens.functions.text import blank_to_null
from runlens.operators.fingerprint import fingerprints, manifest_key, resolve_artifacts, unchanged_jobs

ENTRY_FIELDS = ("content_sha256", "blob_url", "url", "filename", "path", "name")


def _text(v, path: str):
    return F.try_variant_get(v, path, "string")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(url, doc, deal_id, part, as_of, context_domain_pack, domain_pack, artifacts,
    broken) per file below ``path``. ``broken``: ``unreadable`` (no JSON),
    ``not_an_object``, ``artifacts_not_a_list``, or null. ``artifacts`` is an
    array of VARIANT, empty where the document names none."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    docs = files.select(F.col("_metadata.file_path").alias("url"), F.try_parse_json("value").alias("doc"))
    doc, found = F.col("doc"), F.try_variant_get("doc", "$.artifacts", "variant")
    docs = docs.select("url", "doc", is_object(doc).alias("ok"), F.coalesce(vtype(found), F.lit("VOID")).alias("kind"))
    broken = (F.when(doc.isNull(), "unreadable").when(~F.col("ok"), "not_an_object")
               .when(~(F.col("kind").startswith("ARRAY") | (F.col("kind") == "VOID")), "artifacts_not_a_list"))
    docs = docs.withColumn("broken", broken).withColumn("doc", F.when(F.col("broken").isNull(), doc))
    return docs.select(
        "url", "doc", _text(doc, "$.deal_id").alias("deal_id"), F.try_variant_get(doc, "$.part", "long").alias("part"),
        blank_to_null(_text(doc, "$.context.as_of")).alias("as_of"), _text(doc, "$.context.domain_pack").alias("context_domain_pack"),
        _text(doc, "$.domain_pack").alias("domain_pack"),
        F.coalesce(F.try_variant_get(doc, "$.artifacts", "array<variant>"), F.array().cast("array<variant>")).alias("artifacts"), "broken")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """The entries of all readable documents: (manifest, pos) and an entry's
    fields; ``pos`` is its place in the document, from 0."""
    entries = manifests.where("broken IS NULL").select(F.struct("url", "deal_id", "part").alias("manifest"), F.posexplode("artifacts").alias("pos", "a"))
    return entries.select("manifest", F.col("pos").cast("bigint").alias("pos"), *[_text("a", f"$.{f}").alias(f) for f in ENTRY_FIELDS])


def manifest_artifacts(manifests: DataFrame) -> DataFrame:
    """P8 over documents: source and stripped name of every usable entry."""
    usable = resolve_artifacts(manifest_entries(manifests).withColumnRenamed("manifest", "deal_id"))
    return usable.select("deal_id.deal_id", "deal_id.part", "pos", "source_url", "rel_path", "content_sha256")


def manifest_keys(manifests: DataFrame) -> DataFrame:
    """A1 over documents: the key of each one's hashes, a per-row expression."""
    hashes = F.transform("artifacts", lambda a: F.try_variant_get(a, "$.content_sha256", "string"))
    return manifests.where("broken IS NULL").select("deal_id", "part", "as_of", F.size("artifacts").cast("bigint").alias("n_artifacts"),
                                                    manifest_key(hashes).alias("artifact_key"))


def manifest_decisions(manifests: DataFrame, previous: DataFrame, forced) -> DataFrame:
    """J1 per document against the documents of an earlier run, by the exact key
    and by the mergeable digest of the exploded entries: the same decisions."""
    def decide(key):
        now, old = key(manifests), key(previous)
        jobs = now.select(F.struct("deal_id", "part").alias("doc"), "artifact_key", "as_of", forced.alias("force"))
        return unchanged_jobs(jobs, old.select(F.struct("deal_id", "part").alias("doc"), "artifact_key", "as_of"), key="doc")

    def digest(m):
        doc = F.struct("deal_id", "part")
        own = m.where("broken IS NULL").select(doc.alias("doc"), "as_of")
        found = fingerprints(m.where("broken IS NULL").select(doc.alias("doc"), F.explode("artifacts").alias("a"))
                              .select("doc", _text("a", "$.content_sha256").alias("content_sha256")), key="doc")
        return own.join(found, "doc").select("doc.deal_id", "doc.part", "as_of", "artifact_key")
    exact, merged = decide(manifest_keys), decide(digest).select("doc", F.col("decision").alias("digest_decision"))
    return exact.join(merged, "doc", "left").select("doc.deal_id", "doc.part", "artifact_key", "has_record", "force", "decision", "digest_decision")
