"""Minimum slice: artifacts -> A1 fingerprint -> J1 unchanged check."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators.fingerprint import fingerprints, unchanged_jobs
from runlens.plans.oracle_ctes import with_ctes
from runlens.plans.registry import register
from runlens.sources.derived import Derived, stored_fingerprints


@register("fingerprints", with_ctes(
    "SELECT deal_id, n_artifacts, artifact_key FROM fingerprints", "fingerprints"))
def q_fingerprints(spark, sf_dir):
    return fingerprints(Derived(spark, sf_dir).artifacts())


def current_jobs(d: Derived):
    """One job per deal: current artifact key, scope, and force flag."""
    m = d.manifests().select("deal_id", "deal_no", "as_of")
    return (fingerprints(d.artifacts()).join(m, "deal_id")
            .select("deal_id", "artifact_key", "as_of",
                    (F.col("deal_no") % 6 == 0).alias("force")))


@register("unchanged_jobs", with_ctes("SELECT * FROM unchanged", "unchanged"))
def q_unchanged_jobs(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return unchanged_jobs(current_jobs(d), stored_fingerprints(d))
