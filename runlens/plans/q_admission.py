"""Decode, routing, options, budget and admission queries (S1, P1-P9, F2-F5,
J2, W1, W3, A7, S11, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import decode as D
from runlens.operators import admission as A
from runlens.operators.fingerprint import unchanged_jobs
from runlens.operators.status import latest_status
from runlens.plans.oracle_ctes import SKIP_LIST, ts_text, with_ctes
from runlens.plans.q_core import current_jobs
from runlens.plans.registry import register
from runlens.session import materialized, task_count
from runlens.sources.derived import Derived, stored_fingerprints


def ts(c):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def decoded(spark, sf_dir):
    """Decoded messages: the ``jobs`` table of the data model, written once
    per session to the shared checkpoint folder (the decode sink's output)
    and read by every downstream query. Reading a written table also stops
    filters on derived flags from being re-expanded into the parse."""
    return materialized(spark, "decoded_messages", sf_dir,
                        lambda: A.decode_messages(Derived(spark, sf_dir).raw_messages(task_count(spark))))


def jobs(spark, sf_dir):
    return decoded(spark, sf_dir).where((F.col("route") == "compile") & F.col("job_ok"))


@register("lane_union", with_ctes(r"""
SELECT message_id, lane, CASE WHEN lane = 'priority' THEN 0 ELSE 1 END AS lane_rank, dequeue_count
FROM raw_messages""", "raw_messages"))
def q_lane_union(spark, sf_dir):
    """The two lanes arrive as separate sources; here they are the two
    halves of the derived queue."""
    msgs = Derived(spark, sf_dir).raw_messages()
    both = A.lane_union(msgs.where(F.col("lane") == "priority").drop("lane"),
                        msgs.where(F.col("lane") == "normal").drop("lane"))
    return both.select("message_id", "lane", A.lane_rank(F.col("lane")).alias("lane_rank"),
                       "dequeue_count")


@register("decode_messages", with_ctes(r"""
SELECT message_id, decoded, route, job_ok FROM decoded_messages""", "decoded_messages"))
def q_decode_messages(spark, sf_dir):
    return decoded(spark, sf_dir).select("message_id", "decoded", "route", "job_ok")


@register("jobs", with_ctes(r"""
SELECT message_id, compile_id, deal_id, manifest_blob_url, domain_pack, force
FROM jobs""", "jobs"))
def q_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).select("message_id", "compile_id", "deal_id",
                                      "manifest_blob_url", "domain_pack", "force")


@register("requesters", with_ctes(r"""
SELECT message_id, triggered_by, trigger_kind FROM jobs""", "jobs"))
def q_requesters(spark, sf_dir):
    return jobs(spark, sf_dir).select("message_id", "triggered_by", "trigger_kind")


@register("route_kind", with_ctes(r"""
SELECT route, count(*) AS messages FROM decoded_messages GROUP BY route""", "decoded_messages"))
def q_route_kind(spark, sf_dir):
    return decoded(spark, sf_dir).groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


_URL_PATH = "ltrim(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"


def _blob_sql(u: str) -> str:
    p = _URL_PATH.format(u=u)
    return (f"CASE WHEN strpos({p}, '/') > 0 THEN url_decode(split_part({p}, '/', 1)) END AS container, "
            f"CASE WHEN strpos({p}, '/') > 0 THEN url_decode(substr({p}, strpos({p}, '/') + 1)) END AS path")


_ART_SRC = "coalesce(nullif(blob_url, ''), nullif(url, ''))"


@register("blob_paths", with_ctes(f"""
SELECT 'manifest' AS kind, CAST(message_id AS VARCHAR) AS id, {_blob_sql('manifest_blob_url')}
FROM jobs
UNION ALL
SELECT 'artifact' AS kind, CAST(pos AS VARCHAR) AS id, {_blob_sql(_ART_SRC)}
FROM artifacts WHERE coalesce(nullif(blob_url, ''), nullif(url, '')) IS NOT NULL
""", "jobs", "artifacts"))
def q_blob_paths(spark, sf_dir):
    j = jobs(spark, sf_dir).select(F.lit("manifest").alias("kind"),
                                   F.col("message_id").cast("string").alias("id"),
                                   F.col("manifest_blob_url").alias("u"))
    src = F.coalesce(F.nullif(F.col("blob_url"), F.lit("")), F.nullif(F.col("url"), F.lit("")))
    a = (Derived(spark, sf_dir).artifacts().where(src.isNotNull())
         .select(F.lit("artifact").alias("kind"), F.col("pos").cast("string").alias("id"),
                 src.alias("u")))
    return j.unionByName(a).select("kind", "id", D.blob_container("u").alias("container"),
                                   D.blob_path("u").alias("path"))


@register("artifacts", with_ctes(r"""
SELECT deal_id, pos, src AS source_url, ltrim(ltrim(rel, '/'), '\') AS rel_path, content_sha256
FROM (SELECT *, coalesce(nullif(blob_url, ''), nullif(url, '')) AS src,
             coalesce(nullif(filename, ''), nullif(path, ''), nullif(name, '')) AS rel
      FROM artifacts)
WHERE src IS NOT NULL AND rel IS NOT NULL""", "artifacts"))
def q_artifacts(spark, sf_dir):
    from runlens.operators.fingerprint import resolve_artifacts
    return resolve_artifacts(Derived(spark, sf_dir).artifacts())


@register("job_options", with_ctes(r"""
SELECT j.message_id, j.deal_id,
       coalesce(nullif(j.domain_pack, ''), nullif(m.context_domain_pack, ''), nullif(m.domain_pack, ''))
         AS domain_pack,
       coalesce(CAST(json_extract(j.msg, '$.compile_options.allow_errors') AS BOOLEAN), true) AS allow_errors,
       coalesce(CAST(json_extract(j.msg, '$.compile_options.allow_unverified_receipts') AS BOOLEAN), true)
         AS allow_unverified,
       coalesce(CAST(json_extract(j.msg, '$.compile_options.use_cache') AS BOOLEAN), false) AS use_cache,
       CAST(json_extract(j.msg, '$.compile_options.abstain_threshold') AS DOUBLE) AS abstain_threshold
FROM jobs j LEFT JOIN manifests m USING (deal_id)""", "jobs", "manifests"))
def q_job_options(spark, sf_dir):
    return A.job_options(jobs(spark, sf_dir), Derived(spark, sf_dir).manifests())


@register("job_budget", with_ctes(r"""
SELECT j.message_id, j.deal_id, coalesce(m.n_artifacts, 0) AS n_docs,
       CAST(least(10800.0, greatest(1500.0, 45.0 * coalesce(m.n_artifacts, 0))) AS DOUBLE) AS budget_sec
FROM jobs j LEFT JOIN manifests m USING (deal_id)""", "jobs", "manifests"))
def q_job_budget(spark, sf_dir):
    m = Derived(spark, sf_dir).manifests().select("deal_id", "n_artifacts")
    return (jobs(spark, sf_dir).join(m, "deal_id", "left")
            .select("message_id", "deal_id",
                    F.coalesce("n_artifacts", F.lit(0)).cast("bigint").alias("n_docs"),
                    A.budget_sec(F.col("n_artifacts")).alias("budget_sec")))


@register("latest_status", with_ctes(f"""
SELECT compile_id, deal_id, status, stage, {ts_text('updated_at')} AS updated_at, seq
FROM latest_status""", "latest_status"))
def q_latest_status(spark, sf_dir):
    return latest_status(Derived(spark, sf_dir).status_events()).select(
        "compile_id", "deal_id", "status", "stage", ts("updated_at").alias("updated_at"), "seq")


@register("rerun_block", with_ctes(r"""
SELECT j.message_id, j.compile_id, s.status AS prev_status, s.stage AS prev_stage,
       CASE WHEN s.status = 'failed' AND s.stage IN ('timeout', 'killed', 'out_of_memory')
            THEN s.stage END AS blocked_stage
FROM jobs j LEFT JOIN latest_status s USING (compile_id)""", "jobs", "latest_status"))
def q_rerun_block(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return A.previous_final(jobs(spark, sf_dir), d.status_events()).select(
        "message_id", "compile_id", "prev_status", "prev_stage", "blocked_stage")


@register("skip_list", with_ctes(r"""
SELECT message_id, deal_id, deal_id IN ('src3', 'src7', 'src11') AS skip_listed FROM jobs""", "jobs"))
def q_skip_list(spark, sf_dir):
    return A.mark_skipped(jobs(spark, sf_dir), A.skip_ids(spark, SKIP_LIST)).select(
        "message_id", "deal_id", "skip_listed")


def decisions(spark, sf_dir):
    d = Derived(spark, sf_dir)
    unchanged = unchanged_jobs(current_jobs(d), stored_fingerprints(d))
    return A.admission(decoded(spark, sf_dir), d.status_events(task_count(spark)), unchanged,
                       A.skip_ids(spark, SKIP_LIST))


@register("admission", with_ctes(r"""
SELECT message_id, lane, dequeue_count, compile_id, deal_id, decision, status, stage,
       poison_reason, exit_code, near_poison, disposition FROM admission""", "admission"))
def q_admission(spark, sf_dir):
    return decisions(spark, sf_dir).drop("content")


@register("poison_archive", with_ctes(r"""
SELECT message_id, poison_reason AS reason, dequeue_count, lane AS source_queue, content AS original,
       CASE WHEN poison_reason <> 'decode_error' THEN deal_id END AS deal_id,
       CASE WHEN poison_reason <> 'decode_error' THEN compile_id END AS compile_id
FROM admission WHERE poison_reason IS NOT NULL""", "admission"))
def q_poison_archive(spark, sf_dir):
    return A.poison_archive(decisions(spark, sf_dir))


@register("brief_outbox", with_ctes(r"""
SELECT message_id, deal_id, compile_id,
       to_base64(encode('{"dealId": ' || CAST(to_json(deal_id) AS VARCHAR) || ', "compileId": '
                        || CAST(to_json(compile_id) AS VARCHAR) || ', "envelopeReady": true}')) AS payload
FROM admission WHERE decision = 'compile'""", "admission"))
def q_brief_outbox(spark, sf_dir):
    return A.brief_outbox(decisions(spark, sf_dir))


@register("lane_backlog", with_ctes(r"""
SELECT lane, count(*) AS messages FROM raw_messages GROUP BY lane""", "raw_messages"))
def q_lane_backlog(spark, sf_dir):
    return A.lane_backlog(Derived(spark, sf_dir).raw_messages())


@register("dispatch_order", with_ctes(r"""
SELECT message_id, lane, lane_pos,
       lane_pos + CASE WHEN lane = 'priority' THEN 0
                       ELSE (SELECT count(*) FROM raw_messages WHERE lane = 'priority') END AS queue_pos
FROM (SELECT message_id, lane,
             row_number() OVER (PARTITION BY lane ORDER BY received_at, message_id) AS lane_pos
      FROM raw_messages)""", "raw_messages"))
def q_dispatch_order(spark, sf_dir):
    return A.dispatch_order(Derived(spark, sf_dir).raw_messages())


@register("give_up_messages", with_ctes(r"""
SELECT message_id, compile_id, stage,
       CASE WHEN decision = 'exhausted_retries' THEN 'dequeue_count ' || CAST(dequeue_count AS VARCHAR) || ' > 3'
            ELSE e || '; not re-run (dequeue_count ' || CAST(dequeue_count AS VARCHAR) || ')' END AS error,
       CASE WHEN decision = 'exhausted_retries'
            THEN 'The parse failed ' || CAST(dequeue_count - 1 AS VARCHAR)
                 || ' times and was not retried again. Press Re-parse to try again.'
            ELSE upper(left(e, 1)) || substr(e, 2) || ', so it was not run again. Press Re-parse to try again.'
       END AS progress_error
FROM (SELECT *, CASE stage WHEN 'timeout' THEN 'compile exceeded COMPILE_TIMEOUT_SEC on an earlier attempt'
                           WHEN 'killed' THEN 'the worker was killed mid-run on an earlier attempt'
                           WHEN 'out_of_memory' THEN 'the compile ran out of memory on an earlier attempt'
                END AS e
      FROM admission WHERE decision IN ('exhausted_retries', 'previous_final'))""", "admission"))
def q_give_up_messages(spark, sf_dir):
    return A.give_up_messages(decisions(spark, sf_dir))


QUEUE_HEAD = 100


@register("queue_head", with_ctes(f"""
SELECT message_id, lane FROM raw_messages
ORDER BY CASE WHEN lane = 'priority' THEN 0 ELSE 1 END, received_at, message_id
LIMIT {QUEUE_HEAD}""", "raw_messages"))
def q_queue_head(spark, sf_dir):
    return A.queue_head(Derived(spark, sf_dir).raw_messages(), QUEUE_HEAD)
