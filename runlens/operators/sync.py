"""Store sync plans (J9, J10, A9, W8), fetch filter and configuration
check (P25, J11, S15), and the sibling upgrade (J8).

The listings are tables; the plan is the output. Executing transfers is
not built (it is a storage client's job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's sync and fetch rules.
REGISTRY_DIR = "_head_registry"
ALWAYS_UPLOAD = ("_training_log.db", "_embed_cache.db")   # in this order, last
LIVE_LOG = "_training_log.db"
SKIP_PREFIXES = ("dataset/",)
SKIP_SUFFIXES = (".png", ".jpg", ".jpeg", ".zip")
SKIP_MARKERS = ("_training_", "_runpod_", "_backup_")
RUNTIME_CREATED = ("cache", "_shadow_history", "_feedback", "_rule_decisions")


def _dir(name):
    return F.substring_index(name, "/", 1)


def sync_plan(local: DataFrame, remote: DataFrame, remote_known: bool = True,
              always_upload: tuple[str, ...] = ALWAYS_UPLOAD) -> DataFrame:
    """J9 + J10: per name, upload (remote lacks it or sizes differ), skip
    (same size), delete (registry only, remote-only, and only when the local
    registry is non-empty), keep; the names in ``always_upload`` (the log and
    the cache) always upload, last and in that order.
    An unknown remote listing uploads everything."""
    loc = local.select("name", F.col("size").alias("local_size"))
    rem = remote.select("name", F.col("size").alias("remote_size"))
    if not remote_known:
        rem = rem.limit(0)
    reg_local = (local.where(_dir(F.col("name")) == REGISTRY_DIR)
                      .agg(F.count(F.lit(1)) > 0).scalar())
    full = loc.join(rem, "name", "full_outer").withColumn("registry_has_local", reg_local)
    always = F.col("name").isin(*always_upload)
    action = (F.when(always & F.col("local_size").isNotNull(), "upload")
               .when(F.col("local_size").isNotNull()
                     & F.coalesce(F.col("remote_size") == F.col("local_size"), F.lit(False)), "skip")
               .when(F.col("local_size").isNotNull(), "upload")
               .when((_dir(F.col("name")) == REGISTRY_DIR) & F.col("registry_has_local"), "delete")
               .otherwise("keep"))
    order = F.coalesce(*[F.when(F.col("name") == name, i + 1) for i, name in enumerate(always_upload)], F.lit(0))
    return full.select("name", _dir(F.col("name")).alias("dir"), "local_size", "remote_size",
                       action.alias("action"), order.alias("upload_order"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """Sent / already current / pruned."""
    return plan.agg(F.count_if(F.col("action") == "upload").alias("sent"),
                    F.count_if(F.col("action") == "skip").alias("current"),
                    F.count_if(F.col("action") == "delete").alias("pruned"))


def store_setops(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Names only local, only remote, in both, and distinct roots."""
    ln, rn = local.select("name"), remote.select("name")
    only_local = ln.subtract(rn).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("only_local").alias("set"), "n")
    only_remote = rn.exceptAll(ln).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("only_remote").alias("set"), "n")
    both = ln.intersect(rn).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("set"), "n")
    roots = ln.unionByName(rn).select(_dir(F.col("name")).alias("r")).distinct().agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("roots").alias("set"), "n")
    return only_local.unionByName(only_remote).unionByName(both).unionByName(roots)


def fetch_filter(names: DataFrame, include_registry: bool = False, live_log: str = LIVE_LOG) -> DataFrame:
    """P25: which store names the fetch downloads (ordered rules). ``live_log``
    is the name of the log that a service writes to, in lower case: it is
    fetched although its name may look like a training dump's."""
    low = F.lower(F.col("name"))
    junk = (F.exists(F.array(*[F.lit(x) for x in SKIP_PREFIXES]), lambda x: low.startswith(x))
            | F.exists(F.array(*[F.lit(x) for x in SKIP_SUFFIXES]), lambda x: low.endswith(x)))
    marked = F.exists(F.array(*[F.lit(m) for m in SKIP_MARKERS]), lambda m: low.contains(m))
    registry = F.lit(not include_registry) & low.startswith(REGISTRY_DIR + "/")
    skip = (F.when(junk, True).when(low == live_log, False).when(marked, True)
             .when(registry, True).otherwise(False))
    return names.select("name", (~skip).alias("fetched"))


def config_check(config: DataFrame, fetched: DataFrame, base: str) -> DataFrame:
    """Configured paths under the base (minus runtime-created and the
    registry) are present (fetched), missing (the store has their root) or
    without source. Semi and anti joins on exact name, then on root."""
    prefix = base.rstrip("/") + "/"
    rel = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    low = F.lower(F.concat(F.element_at(F.split(F.col("path"), "/"), -1), F.lit("|"),
                           F.col("path")))
    runtime = F.exists(F.array(*[F.lit(m) for m in RUNTIME_CREATED]), lambda m: low.contains(m))
    required = (config.where(F.col("path").startswith(prefix) & (F.col("path") != prefix)
                             & ~runtime & ~low.contains(REGISTRY_DIR))
                      .select("key", "path", rel.alias("rel")))
    got = fetched.where("fetched").select(F.col("name").alias("rel"))
    roots = fetched.select(_dir(F.col("name")).alias("root")).distinct()
    present = required.join(got, "rel", "left_semi").withColumn("state", F.lit("present"))
    absent = required.join(got, "rel", "left_anti").withColumn("root", _dir(F.col("rel")))
    missing = absent.join(roots, "root", "left_semi").withColumn("state", F.lit("missing"))
    no_source = absent.join(roots, "root", "left_anti").withColumn("state", F.lit("no_source"))
    return (present.select("key", "path", "state")
            .unionByName(missing.select("key", "path", "state"))
            .unionByName(no_source.select("key", "path", "state")))


def artifact_receipt(fetched: DataFrame, check: DataFrame) -> DataFrame:
    """One receipt row of the fetch."""
    c = check.agg(F.count(F.lit(1)).alias("required"),
                  F.count_if(F.col("state") == "present").alias("present"),
                  F.count_if(F.col("state") == "missing").alias("missing"),
                  F.count_if(F.col("state") == "no_source").alias("no_source"))
    j = c.select(fetched.agg(F.count_if("fetched")).scalar().alias("downloaded"),
                 fetched.agg(F.count_if(~F.col("fetched"))).scalar().alias("skipped"), "*")
    return j.select("*", F.lit(0).cast("bigint").alias("extract_errors"),
                    ((F.col("downloaded") > 0) & (F.col("missing") == 0)).alias("ok"))


def largest_sibling(listing: DataFrame) -> DataFrame:
    """J8 (contract only): among siblings sharing a base name, prefer the
    largest (ties by name). The reference delegates dedup to an external
    helper; ours keeps one row per (deal, base) and counts exact copies
    (same content hash) once. ``max`` over a struct is a partial aggregate,
    so a deal with many siblings is reduced map-side; the distinct count
    is a two-level aggregate (dedup per hash first)."""
    per_hash = listing.groupBy("deal_id", "base", "content_sha256").agg(
        F.max(F.struct("size", F.col("name"))).alias("_h"), F.count(F.lit(1)).alias("_n"))
    best = per_hash.groupBy("deal_id", "base").agg(
        F.max("_h").alias("_b"), F.sum("_n").alias("siblings"),
        F.count(F.lit(1)).alias("distinct_siblings"))
    return best.select("deal_id", "base", F.col("_b.name").alias("name"),
                       F.col("_b.size").alias("size"), "siblings", "distinct_siblings")
