"""Store sync, fetch check and draft queries (P20-P22, P25, J8-J11, A9, W8,
S15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import drafts as DR
from runlens.operators import sync as SY
from runlens.plans.oracle_ctes import with_ctes
from runlens.plans.registry import register
from runlens.sources.derived import (ML_BASE, Derived, artifact_config, draft_inputs, draft_tables,
                                     fetch_names, local_listing, remote_listing, sibling_listing)


def _plan(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return SY.sync_plan(local_listing(d), remote_listing(d))


@register("sync_plan", with_ctes("SELECT * FROM sync_plan", "sync_plan"))
def q_sync_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@register("mirror_delete", with_ctes(
    "SELECT name FROM sync_plan WHERE action = 'delete'", "sync_plan"))
def q_mirror_delete(spark, sf_dir):
    return _plan(spark, sf_dir).where("action = 'delete'").select("name")


@register("sync_counts", with_ctes(r"""
SELECT count(*) FILTER (WHERE action = 'upload') AS sent, count(*) FILTER (WHERE action = 'skip') AS current,
       count(*) FILTER (WHERE action = 'delete') AS pruned FROM sync_plan""", "sync_plan"))
def q_sync_counts(spark, sf_dir):
    return SY.sync_counts(_plan(spark, sf_dir))


@register("store_setops", with_ctes(r"""
SELECT 'only_local' AS set, count(*) AS n FROM (SELECT name FROM local_listing EXCEPT SELECT name FROM remote_listing)
UNION ALL
SELECT 'only_remote', count(*) FROM (SELECT name FROM remote_listing EXCEPT ALL SELECT name FROM local_listing)
UNION ALL
SELECT 'both', count(*) FROM (SELECT name FROM local_listing INTERSECT SELECT name FROM remote_listing)
UNION ALL
SELECT 'roots', count(DISTINCT split_part(name, '/', 1))
FROM (SELECT name FROM local_listing UNION ALL SELECT name FROM remote_listing)""",
    "local_listing", "remote_listing"))
def q_store_setops(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return SY.store_setops(local_listing(d), remote_listing(d))


def _fetched(spark, sf_dir):
    return SY.fetch_filter(fetch_names(Derived(spark, sf_dir)))


@register("fetch_filter", with_ctes("SELECT name, fetched FROM fetch_filter", "fetch_filter"))
def q_fetch_filter(spark, sf_dir):
    return _fetched(spark, sf_dir)


@register("config_check", with_ctes("SELECT key, path, state FROM config_check", "config_check"))
def q_config_check(spark, sf_dir):
    return SY.config_check(artifact_config(Derived(spark, sf_dir)), _fetched(spark, sf_dir), ML_BASE)


@register("artifact_receipt", with_ctes(r"""
SELECT (SELECT count(*) FILTER (WHERE fetched) FROM fetch_filter) AS downloaded,
       (SELECT count(*) FILTER (WHERE NOT fetched) FROM fetch_filter) AS skipped,
       count(*) AS required, count(*) FILTER (WHERE state = 'present') AS present,
       count(*) FILTER (WHERE state = 'missing') AS missing,
       count(*) FILTER (WHERE state = 'no_source') AS no_source,
       CAST(0 AS BIGINT) AS extract_errors,
       (SELECT count(*) FILTER (WHERE fetched) FROM fetch_filter) > 0
         AND count(*) FILTER (WHERE state = 'missing') = 0 AS ok
FROM config_check""", "config_check", "fetch_filter"))
def q_artifact_receipt(spark, sf_dir):
    fetched = _fetched(spark, sf_dir)
    check = SY.config_check(artifact_config(Derived(spark, sf_dir)), fetched, ML_BASE)
    return SY.artifact_receipt(fetched, check)


@register("largest_sibling", r"""
SELECT source AS deal_id, 'mail-' || CAST(doc_id % 50 AS VARCHAR) AS base,
       arg_max('mail-' || CAST(doc_id % 50 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.eml',
               (n_chars, 'mail-' || CAST(doc_id % 50 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.eml'))
         AS name,
       max(n_chars) AS size, count(*) AS siblings, count(DISTINCT sha256(text)) AS distinct_siblings
FROM documents GROUP BY 1, 2""")
def q_largest_sibling(spark, sf_dir):
    return SY.largest_sibling(sibling_listing(Derived(spark, sf_dir)))


@register("draft_summary", with_ctes(r"""
SELECT deal_id, st AS draft_status, s_failed_because AS failed_because,
       s_degraded_because AS degraded_because, s_llm_failures AS llm_failures,
       site_source, job_family, job_family_by, origin_counts
FROM draft_summary""", "draft_summary"))
def q_draft_summary(spark, sf_dir):
    return DR.draft_summary(draft_inputs(Derived(spark, sf_dir)))


@register("draft_merge", with_ctes(r"""
SELECT request_id, deal_id, left(coalesce(requested_by, ''), 120) AS requested_by,
       CASE WHEN has_brief THEN 'done' ELSE 'failed' END AS state,
       CASE WHEN has_brief THEN envelope_compile_id END AS compile_id,
       CASE WHEN has_brief THEN n_locations END AS locations,
       CASE WHEN has_brief THEN st ELSE 'failed' END AS draft_status,
       CASE WHEN has_brief THEN s_failed_because
            ELSE 'RuntimeError: the latest envelope has no brief; compile the deal first' END AS failed_because,
       CASE WHEN has_brief THEN s_degraded_because END AS degraded_because,
       CASE WHEN has_brief THEN s_llm_failures END AS llm_failures,
       CASE WHEN has_brief THEN origin_counts END AS origin_counts,
       CASE WHEN NOT has_brief THEN 'RuntimeError: the latest envelope has no brief; compile the deal first' END
         AS error,
       CASE WHEN has_brief THEN 'draft_run' END AS written_on,
       has_brief AND has_handoff AS handoff_updated
FROM draft_summary WHERE regexp_full_match(deal_id, '[0-9a-fA-F-]{36}')""", "draft_summary"))
def q_draft_merge(spark, sf_dir):
    return DR.draft_merge(*draft_tables(Derived(spark, sf_dir)))


@register("draft_documents", with_ctes(r"""
SELECT unnest(CASE WHEN has_handoff THEN ['envelope', 'handoff'] ELSE ['envelope'] END) AS document, deal_id,
       envelope_compile_id AS compile_id, 'draft_run' AS written_on, job_family,
       CAST(n_locations AS BIGINT) AS locations
FROM draft_summary WHERE has_brief AND regexp_full_match(deal_id, '[0-9a-fA-F-]{36}')""", "draft_summary"))
def q_draft_documents(spark, sf_dir):
    docs = DR.merged_documents(*draft_tables(Derived(spark, sf_dir)))
    d = F.from_json("draft", "job_family string, locations array<struct<site: string>>")
    return docs.select("document", "deal_id", "compile_id", "written_on", d["job_family"].alias("job_family"),
                       F.size(d["locations"]).cast("bigint").alias("locations"))
