"""DuckDB definitions of the derived tables (FIXTURES.md part B).

Written independently of the Spark code in ``runlens.sources.derived`` so
the oracle check compares two derivations, not one.
"""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTE[name] = (deps, sql)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTE[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTE[n][1]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {parts},\n{stripped[5:]}"
    return f"WITH {parts}\n{body}"


cte("raw_messages", r"""
SELECT message_id, lane, received_at, dequeue_count,
       CASE WHEN message_id % 17 = 0 THEN left(txt, 10) ELSE txt END AS content
FROM (
  SELECT message_id, lane, received_at, dequeue_count,
         CASE WHEN message_id % 3 = 1 THEN to_base64(encode(body)) ELSE body END AS txt
  FROM (
    SELECT o_orderkey AS message_id,
           CASE WHEN o_orderpriority < '3' THEN 'priority' ELSE 'normal' END AS lane,
           CAST(o_orderdate AS TIMESTAMP) AS received_at,
           CAST(1 + o_orderkey % 5 AS INTEGER) AS dequeue_count,
           '{' || concat_ws(', ',
             CASE WHEN o_orderkey % 29 <> 0 THEN '"compile_id": "' || CAST(o_custkey // 10 AS VARCHAR)
                  || '-' || strftime(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER), '%Y%m%d') || '"' END,
             '"deal_id": "src' || CAST(o_custkey % 20 AS VARCHAR) || '"',
             '"manifest_blob_url": "https://acct.example/box/deal%20' || CAST(o_custkey % 20 AS VARCHAR)
                  || '/m+' || CAST(o_orderkey AS VARCHAR) || '.json"',
             CASE WHEN o_orderkey % 4 = 0 THEN '"domain_pack": "dp' || CAST(o_orderkey % 3 AS VARCHAR) || '"'
                  WHEN o_orderkey % 4 = 1 THEN '"domain_pack": ""' END,
             CASE WHEN o_orderkey % 13 = 0 THEN '"compile_options": {"force": "false", "abstain_threshold": 0.' || CAST(o_orderkey % 5 AS VARCHAR) || '}' END,
             CASE WHEN o_orderkey % 11 = 0 THEN '"force": true' END,
             CASE WHEN o_orderkey % 23 = 0 THEN '"kind": "sow_draft"' END,
             CASE o_orderkey % 6
                  WHEN 0 THEN '"triggered_by": "u' || CAST(o_orderkey % 7 AS VARCHAR) || '"'
                  WHEN 1 THEN '"triggeredBy": "U' || CAST(o_orderkey % 5 AS VARCHAR) || '"'
                  WHEN 2 THEN '"trigger": {"kind": "manual", "by": "p' || CAST(o_orderkey % 3 AS VARCHAR) || '"}'
                  WHEN 3 THEN '"trigger": {"kind": "timer"}'
                  WHEN 4 THEN '"triggered_by": "   ", "trigger": {"kind": " ", "by": ""}' END
           ) || '}' AS body
    FROM orders))
""")

cte("artifacts", r"""
SELECT source AS deal_id, doc_id AS pos,
       CASE WHEN doc_id % 97 = 0 THEN NULL ELSE sha256(text) END AS content_sha256,
       CASE WHEN doc_id % 50 = 0 THEN NULL
            ELSE 'https://acct.example/box/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS blob_url,
       CASE WHEN doc_id % 50 = 0 AND doc_id % 100 <> 0
            THEN 'https://acct.example/alt%20box/' || CAST(doc_id AS VARCHAR) || '+v.txt' END AS url,
       CASE WHEN doc_id % 2 = 0 THEN '//docs/' || CAST(doc_id AS VARCHAR) || '.txt' END AS filename,
       CASE WHEN doc_id % 10 = 5 THEN 'p/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path,
       CASE WHEN doc_id % 2 = 1 THEN '\' || CAST(doc_id AS VARCHAR) || '.txt' END AS name,
       n_chars AS size
FROM documents
""")

cte("manifests", r"""
SELECT deal_id, deal_no, n_artifacts,
       CASE WHEN deal_no % 3 = 0 THEN NULL
            WHEN deal_no % 3 = 1 AND deal_no % 2 = 0 THEN '   '
            ELSE ' 2026-01-0' || CAST(deal_no % 9 + 1 AS VARCHAR) || ' ' END AS as_of,
       CASE WHEN deal_no % 4 = 0 THEN 'ctx' || CAST(deal_no % 2 AS VARCHAR)
            WHEN deal_no % 4 = 1 THEN '' END AS context_domain_pack,
       CASE WHEN deal_no % 5 = 0 THEN 'm' || CAST(deal_no AS VARCHAR) END AS domain_pack
FROM (SELECT source AS deal_id, CAST(substr(source, 4) AS INTEGER) AS deal_no,
             count(*) AS n_artifacts
      FROM documents GROUP BY source)
""")

# Mergeable multiset digest of a deal's artifact hashes (see fingerprint.py).
FP_DIGEST = r"""
SELECT deal_id, count(*) AS n_artifacts,
       sha256(concat_ws(':', CAST(count(*) AS VARCHAR),
         CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR),
         CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR),
         CAST(sum(('0x' || substr(h, 31, 15))::BIGINT) AS VARCHAR),
         CAST(sum(('0x' || substr(h, 46, 15))::BIGINT) AS VARCHAR))) AS artifact_key
FROM (SELECT deal_id, pos, sha256(coalesce(content_sha256, '')) AS h FROM artifacts {where})
GROUP BY deal_id
"""

cte("fingerprints", FP_DIGEST.format(where=""), ("artifacts",))

cte("stored_fingerprints", r"""
SELECT p.deal_id, p.artifact_key,
       CASE WHEN m.deal_no % 5 = 0 THEN NULL ELSE m.as_of END AS as_of
FROM (""" + FP_DIGEST.format(where="WHERE pos % 130 <> 7") + r""") p
JOIN manifests m USING (deal_id)
WHERE m.deal_no <> 19
""", ("artifacts", "manifests"))


# --- JSON helpers for the decode oracles (DuckDB json extension) ----------
def j_truthy(doc: str, path: str) -> str:
    t = f"json_type({doc}, '{path}')"
    return (f"coalesce(CASE {t} WHEN 'NULL' THEN false "
            f"WHEN 'BOOLEAN' THEN CAST(json_extract({doc}, '{path}') AS BOOLEAN) "
            f"WHEN 'VARCHAR' THEN length(json_extract_string({doc}, '{path}')) > 0 "
            f"WHEN 'ARRAY' THEN json_array_length({doc}, '{path}') > 0 "
            f"WHEN 'OBJECT' THEN len(json_keys({doc}, '{path}')) > 0 "
            f"ELSE CAST(json_extract({doc}, '{path}') AS DOUBLE) <> 0 END, false)")


def j_str(doc: str, path: str) -> str:
    t = f"json_type({doc}, '{path}')"
    return (f"CASE WHEN {t} = 'NULL' THEN 'None' WHEN {t} = 'BOOLEAN' THEN "
            f"CASE WHEN CAST(json_extract({doc}, '{path}') AS BOOLEAN) THEN 'True' ELSE 'False' END "
            f"ELSE json_extract_string({doc}, '{path}') END")


def j_truthy_text(doc: str, path: str) -> str:
    return f"CASE WHEN {j_truthy(doc, path)} THEN {j_str(doc, path)} ELSE '' END"


def _requester(doc: str) -> str:
    flat = (f"trim(CASE WHEN {j_truthy(doc, '$.triggered_by')} THEN {j_str(doc, '$.triggered_by')} "
            f"WHEN {j_truthy(doc, '$.triggeredBy')} THEN {j_str(doc, '$.triggeredBy')} ELSE '' END)")
    obj = f"coalesce(json_type({doc}, '$.trigger') = 'OBJECT', false)"
    by = f"trim({j_truthy_text(doc, '$.trigger.by')})"
    kind = f"trim({j_truthy_text(doc, '$.trigger.kind')})"
    return (f"CASE WHEN {flat} <> '' THEN {flat} WHEN {obj} AND {by} <> '' THEN {by} "
            f"WHEN {obj} AND {kind} <> '' THEN {kind} END")


_B64 = "regexp_replace(trim(coalesce(content, '')), '[^A-Za-z0-9+/=]', '', 'g')"
_STRICT = "'^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$'"

cte("decoded_messages", f"""
SELECT message_id, lane, received_at, dequeue_count, content,
       msg IS NOT NULL AS decoded,
       CASE WHEN ltrim(ptxt) LIKE '{{%' AND coalesce(json_valid(ptxt), false)
                 AND json_type(ptxt) = 'OBJECT' AND json_extract_string(ptxt, '$.kind') = 'sow_draft'
            THEN 'draft' ELSE 'compile' END AS route,
       coalesce(msg IS NOT NULL AND json_extract(msg, '$.compile_id') IS NOT NULL
         AND json_extract(msg, '$.deal_id') IS NOT NULL
         AND json_extract(msg, '$.manifest_blob_url') IS NOT NULL
         AND NOT ({j_truthy('msg', '$.compile_options')} AND coalesce(json_type(msg, '$.compile_options') <> 'OBJECT', true))
         AND NOT ({j_truthy('msg', '$.trigger')} AND coalesce(json_type(msg, '$.trigger') <> 'OBJECT', true)),
         false) AS job_ok,
       {j_str('msg', '$.compile_id')} AS compile_id,
       {j_str('msg', '$.deal_id')} AS deal_id,
       {j_str('msg', '$.manifest_blob_url')} AS manifest_blob_url,
       json_extract_string(msg, '$.domain_pack') AS domain_pack,
       ({j_truthy('msg', '$.force')} OR (coalesce(json_type(msg, '$.compile_options') = 'OBJECT', false)
          AND {j_truthy('msg', '$.compile_options.force')})) AS force,
       {_requester('msg')} AS triggered_by,
       CASE WHEN coalesce(json_type(msg, '$.trigger') = 'OBJECT', false)
                 AND trim({j_truthy_text('msg', '$.trigger.kind')}) <> ''
            THEN trim({j_truthy_text('msg', '$.trigger.kind')}) END AS trigger_kind,
       msg
FROM (
  SELECT *,
         CASE WHEN coalesce(json_valid(t), false) AND json_type(t) = 'OBJECT' THEN t
              WHEN coalesce(json_valid(b), false) AND json_type(b) = 'OBJECT' THEN b END AS msg,
         CASE WHEN ltrim(coalesce(content, '')) LIKE '{{%' THEN content
              WHEN regexp_full_match(trim(coalesce(content, '')), {_STRICT})
              THEN try(decode(from_base64(trim(content)))) END AS ptxt
  FROM (SELECT *, trim(coalesce(content, '')) AS t,
               CASE WHEN length({_B64}) % 4 = 0 THEN try(decode(from_base64({_B64}))) END AS b
        FROM raw_messages))
""", ("raw_messages",))

cte("status_events", r"""
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS compile_id,
       'd' || CAST(user_id AS VARCHAR) AS deal_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'running'
            WHEN event_type = 'purchase' THEN 'completed'
            WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 1 THEN 'interrupted' ELSE 'cancelled' END
            ELSE 'failed' END AS status,
       CASE WHEN event_type = 'view' THEN 'parse' WHEN event_type = 'click' THEN 'enrich'
            WHEN event_type = 'purchase' THEN 'done'
            WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 1 THEN 'terminated' ELSE 'cancelled' END
            ELSE ['timeout', 'killed', 'out_of_memory', 'exception', 'exhausted_retries'][event_id % 5 + 1]
       END AS stage,
       ts AS updated_at, event_id AS seq, value AS elapsed_sec, k AS atom_count,
       k // 3 AS entity_count,
       CAST(CASE WHEN event_type = 'purchase' THEN 100 ELSE k END AS INTEGER) AS percent_complete,
       CASE WHEN event_type = 'error' THEN repeat('E', CAST(480 + event_id % 60 AS INTEGER)) END AS error,
       CASE WHEN event_type = 'error' THEN 'Traceback #' || CAST(event_id AS VARCHAR) END AS traceback,
       'w' || CAST(user_id % 3 AS VARCHAR) AS worker_sha,
       'p' || CAST(user_id % 2 AS VARCHAR) AS parser_sha,
       user_id, event_type, event_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")

cte("latest_status", r"""
SELECT * FROM status_events
QUALIFY row_number() OVER (PARTITION BY compile_id ORDER BY updated_at DESC, seq DESC) = 1
""", ("status_events",))

cte("jobs", r"""
SELECT * FROM decoded_messages WHERE route = 'compile' AND job_ok
""", ("decoded_messages",))


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"

cte("unchanged", r"""
SELECT c.deal_id, c.artifact_key, c.as_of, s.artifact_key AS stored_key,
       s.as_of AS stored_as_of, s.deal_id IS NOT NULL AS has_record, c.force,
       coalesce(s.artifact_key = c.artifact_key AND s.as_of IS NOT DISTINCT FROM c.as_of, false)
         AS unchanged,
       CASE WHEN NOT c.force AND coalesce(s.artifact_key = c.artifact_key
                 AND s.as_of IS NOT DISTINCT FROM c.as_of, false)
            THEN 'skip_unchanged' ELSE 'compile' END AS decision
FROM (SELECT f.deal_id, f.artifact_key, nullif(trim(m.as_of), '') AS as_of,
             m.deal_no % 6 = 0 AS force
      FROM fingerprints f JOIN manifests m USING (deal_id)) c
LEFT JOIN (SELECT deal_id, artifact_key, nullif(trim(as_of), '') AS as_of
           FROM stored_fingerprints) s USING (deal_id)
""", ("fingerprints", "stored_fingerprints", "manifests"))

SKIP_LIST = "src3, src7 ,, src11"
SKIP_SQL = "('src3', 'src7', 'src11')"

cte("admission", f"""
SELECT message_id, lane, dequeue_count, content, compile_id, deal_id, decision,
  CASE WHEN decision IN ('draft', 'decode_error', 'skip_listed') THEN NULL
       WHEN decision IN ('exhausted_retries', 'previous_final') THEN 'failed'
       WHEN decision = 'skip_unchanged' THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN decision IN ('draft', 'decode_error', 'skip_listed') THEN NULL
       WHEN decision = 'exhausted_retries' THEN 'exhausted_retries'
       WHEN decision = 'previous_final' THEN blocked_stage
       WHEN decision = 'skip_unchanged' THEN 'skipped_unchanged' ELSE 'starting' END AS stage,
  CASE WHEN decision = 'decode_error' THEN 'decode_error'
       WHEN decision = 'exhausted_retries' THEN 'exhausted_retries'
       WHEN decision = 'previous_final' THEN
         CASE WHEN blocked_stage = 'timeout' THEN 'timed_out_before' ELSE blocked_stage || '_before' END
  END AS poison_reason,
  CAST(CASE WHEN decision IN ('decode_error', 'exhausted_retries', 'previous_final') THEN 2 ELSE 0 END
       AS INTEGER) AS exit_code,
  (decision <> 'draft' AND job_ok AND dequeue_count >= 3) AS near_poison,
  CASE WHEN decision IN ('decode_error', 'exhausted_retries', 'previous_final') THEN 'poison'
       WHEN decision = 'compile' THEN 'run' ELSE 'ack' END AS disposition
FROM (
  SELECT m.*, b.blocked_stage,
    CASE WHEN m.route = 'draft' THEN 'draft'
         WHEN NOT m.job_ok THEN 'decode_error'
         WHEN m.dequeue_count > 3 THEN 'exhausted_retries'
         WHEN m.dequeue_count > 1 AND b.blocked_stage IS NOT NULL THEN 'previous_final'
         WHEN m.deal_id IN {SKIP_SQL} THEN 'skip_listed'
         WHEN NOT m.force AND coalesce(u.unchanged, false) THEN 'skip_unchanged'
         ELSE 'compile' END AS decision
  FROM decoded_messages m
  LEFT JOIN (SELECT compile_id, CASE WHEN status = 'failed'
                    AND stage IN ('timeout', 'killed', 'out_of_memory') THEN stage END AS blocked_stage
             FROM latest_status) b ON b.compile_id = m.compile_id
  LEFT JOIN unchanged u ON u.deal_id = m.deal_id)
""", ("decoded_messages", "latest_status", "unchanged"))

cte("progress_events", r"""
SELECT compile_id, deal_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status,
       stage AS current_stage, updated_at, seq, 'r' || CAST(user_id % 4 AS VARCHAR) AS replica,
       '["' || stage || '"]' AS stages, strftime(updated_at, '%Y-%m-%d') AS started_at,
       CAST(atom_count % 12 AS BIGINT) AS stage_count_done, CAST(12 AS BIGINT) AS stage_count_total_estimate,
       CASE WHEN seq % 5 <> 0 THEN 'pm' || CAST(seq % 4 AS VARCHAR) END AS triggered_by,
       CASE WHEN seq % 2 = 0 THEN 'manual' END AS trigger_kind,
       CAST(sum(atom_count) OVER (PARTITION BY compile_id, stage ORDER BY updated_at, seq
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stage_items_done,
       CAST(100 * count(*) OVER (PARTITION BY compile_id, stage) AS BIGINT) AS stage_items_total
FROM status_events
""", ("status_events",))

cte("latest_progress", r"""
SELECT * FROM progress_events
QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY updated_at DESC, seq DESC) = 1
""", ("progress_events",))

cte("active_markers", r"""
SELECT compile_id, deal_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE stage END AS stage, updated_at,
       'r' || CAST(user_id % 4 AS VARCHAR) AS replica,
       'b' || CAST(day(updated_at) // 10 AS VARCHAR) AS boot_id
FROM status_events
QUALIFY row_number() OVER (PARTITION BY compile_id ORDER BY updated_at, seq) = 1
""", ("status_events",))

cte("active_runs", r"""
SELECT * FROM active_markers
WHERE compile_id NOT IN (SELECT compile_id FROM status_events
                         WHERE status IN ('completed', 'failed', 'interrupted', 'cancelled'))
""", ("active_markers", "status_events"))

cte("replica_boots", r"""
SELECT 'r' || CAST(user_id % 4 AS VARCHAR) AS replica,
       'b' || CAST(day(ts) // 10 AS VARCHAR) AS boot_id, min(ts) AS booted_at
FROM events GROUP BY 1, 2
""")

cte("current_boots", r"""
SELECT replica, boot_id AS current_boot FROM replica_boots
QUALIFY row_number() OVER (PARTITION BY replica ORDER BY booted_at DESC, boot_id DESC) = 1
""", ("replica_boots",))

cte("memory_samples", r"""
SELECT compile_id, deal_id, updated_at AS sampled_at, seq,
       CAST(floor(elapsed_sec * 16777216) AS BIGINT) AS rss_bytes,
       CAST(200 AS BIGINT) * 16777216 AS limit_bytes, 0.9 AS fraction
FROM status_events
""", ("status_events",))

cte("cancel_requests", r"""
SELECT event_id AS request_id, deal_id,
       CASE WHEN event_id % 15 = 0 THEN ' ' || chr(9) WHEN event_id % 3 = 0 THEN NULL
            WHEN event_id % 15 = 1 THEN chr(10) || ' ' || compile_id || chr(160)
            WHEN event_id % 15 = 4 THEN CAST(user_id + 1 AS VARCHAR) || '-' || strftime(updated_at, '%Y%m%d')
            WHEN event_id % 3 = 1 THEN compile_id
            ELSE CAST(user_id AS VARCHAR) || '-' || strftime(updated_at - INTERVAL 1 DAY, '%Y%m%d') END
         AS compile_id,
       'pm' || CAST(event_id % 4 AS VARCHAR) AS requested_by, updated_at AS requested_at
FROM status_events WHERE event_type = 'signup'
""", ("status_events",))

cte("errors", r"""
SELECT event_id AS error_id, compile_id, deal_id, updated_at AS failed_at,
       ['ResourceNotFoundError', 'HttpResponseError', 'NotFoundError', 'TimeoutError',
        'ValueError'][event_id % 5 + 1] AS error_type,
       ['ResourceNotFoundError: BlobNotFound', 'HttpResponseError: The specified blob does not exist.',
        'NotFoundError: blob gone', 'TimeoutError: t', 'ValueError: notfound'][event_id % 5 + 1] AS error,
       repeat('T', CAST(3990 + event_id % 20 AS INTEGER)) AS traceback
FROM status_events WHERE event_type = 'error'
""", ("status_events",))

cte("attempts", r"""
SELECT 'msg' || CAST(user_id AS VARCHAR) AS message_key, compile_id, event_id AS seq,
       updated_at AS received_at,
       make_timestamp(epoch_us(updated_at) + CAST(round(elapsed_sec * 60000000) AS BIGINT)) AS ended_at
FROM status_events
""", ("status_events",))

cte("run_spans", r"""
SELECT compile_id, any_value(deal_id) AS deal_id, min(updated_at) AS started_at,
       max(updated_at) AS last_at,
       min(CASE WHEN status IN ('completed', 'failed', 'interrupted', 'cancelled') THEN updated_at END)
         AS ended_at,
       (SELECT max(updated_at) FROM status_events) AS now
FROM status_events GROUP BY compile_id
""", ("status_events",))

cte("atoms_raw", r"""
SELECT *, prefix || text AS raw_text,
       CASE WHEN turn % 5 <> 0 THEN prefix || text END AS v_text
FROM (
  SELECT *, CASE WHEN turn % 4 = 1 AND coalesce(said_by, speaker, loc_speaker_eff) IS NOT NULL
                 THEN coalesce(said_by, speaker, loc_speaker_eff) || ' — ' ELSE '' END AS prefix
  FROM (
    SELECT c.conv_id * 1000 + c.turn AS id, 'src' || CAST(c.conv_id % 20 AS VARCHAR) AS deal_id,
           c.conv_id, c.turn, c.role, c.text,
           CASE c.role WHEN 'system' THEN 'constraint' WHEN 'user' THEN 'request'
                       WHEN 'assistant' THEN 'answer' END AS atom_type,
           'art-' || CAST(c.conv_id % 20 AS VARCHAR) AS artifact_id,
           CAST(c.turn + 1 AS DOUBLE) / 10 AS confidence,
           CASE WHEN c.turn % 2 = 0 THEN CAST(c.turn + 1 AS DOUBLE) / 20 END AS calibrated_confidence,
           CASE WHEN c.conv_id % 3 = 0 THEN 'P' || CAST(c.conv_id AS VARCHAR) || ' · Org' END AS said_by,
           CASE WHEN c.turn % 2 = 0 THEN c.role END AS speaker,
           CASE WHEN c.conv_id % 7 <> 0 AND c.turn % 3 = 0 THEN 'L' || c.role END AS loc_speaker_eff,
           CASE WHEN c.conv_id % 7 <> 0 THEN 'turn/' || CAST(c.turn AS VARCHAR) END AS loc_section_path,
           CASE WHEN c.turn % 3 = 1 THEN 'party' || CAST(c.conv_id % 2 AS VARCHAR) END AS v_party,
           CASE WHEN c.conv_id % 7 <> 0 AND c.conv_id % 10 <> 0
                THEN 'conv-' || CAST(c.conv_id % 20 AS VARCHAR) || '.txt' END AS ref_filename,
           CASE WHEN c.conv_id % 7 <> 0 AND c.conv_id % 2 = 0 THEN 'a' || CAST(c.conv_id AS VARCHAR) END
             AS ref_artifact_id,
           CASE WHEN c.conv_id % 7 <> 0 THEN 'chat' END AS ref_method,
           l.doc_id IS NOT NULL AS labelled, l.quality, l.toxic,
           CASE WHEN c.role = 'system' THEN 'policy' ELSE 'party' END AS authority_class,
           CASE WHEN c.turn % 3 = 0 THEN 'pending' ELSE 'accepted' END AS review_status
    FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id))
""")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


cte("atoms_parts", f"""
  SELECT *, CASE WHEN label <> '' AND starts_with(body0, label)
                      AND strpos(left(body0, length(label) + 4), ' — ') > 0
                      AND {_strip("substr(body0, strpos(body0, ' — ') + 3)")} <> ''
                 THEN {_strip("substr(body0, strpos(body0, ' — ') + 3)")} ELSE body0 END AS body
  FROM (
    SELECT *, CASE WHEN said <> '' THEN said ELSE spk END AS label
    FROM (
      SELECT *, {_strip("coalesce(said_by, '')")} AS said,
             CASE WHEN {_strip("coalesce(speaker, '')")} <> '' THEN {_strip("coalesce(speaker, '')")}
                  ELSE {_strip("coalesce(loc_speaker_eff, '')")} END AS spk,
             CASE WHEN {_strip("coalesce(v_text, '')")} <> '' THEN {_strip("coalesce(v_text, '')")}
                  ELSE coalesce(raw_text, '') END AS body0
      FROM atoms_raw))
""", ("atoms_raw",))

# Every key of the written maps: what the fixture puts in, and what the rules fill in.
_V = {"party": "CASE WHEN turn % 3 = 1 THEN 'party' || CAST(conv_id % 2 AS VARCHAR) END",
      "speaker_role": "CASE WHEN conv_id % 4 = 0 THEN 'role' || CAST(conv_id % 3 AS VARCHAR) END",
      "affiliation": "CASE WHEN turn % 4 = 2 THEN 'aff' || CAST(conv_id % 5 AS VARCHAR) END",
      "voice": "CASE WHEN conv_id % 6 = 1 THEN 'v' || CAST(turn % 2 AS VARCHAR) END",
      "org_role": "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'o' END"}
_L = {"voice": "CASE WHEN conv_id % 7 <> 0 AND conv_id % 12 = 1 THEN 'lv' END"}
_OPEN = [("value", "text", "CASE WHEN body <> '' THEN body ELSE v_text END"),
         ("value", "speaker", "CASE WHEN spk <> '' AND coalesce(speaker, '') = '' THEN spk ELSE speaker END"),
         ("value", "said_by", "CASE WHEN said <> '' AND coalesce(said_by, '') = '' THEN said ELSE said_by END"),
         ("value", "mood", "CASE WHEN turn % 7 = 3 THEN 'calm' END"), *[("value", k, x) for k, x in _V.items()],
         ("locator", "section_path", "CASE WHEN label <> '' THEN label ELSE loc_section_path END"),
         ("locator", "speaker", "CASE WHEN label <> '' AND spk <> '' AND coalesce(loc_speaker_eff, '') = '' THEN spk ELSE loc_speaker_eff END"),
         ("locator", "page", "CASE WHEN conv_id % 7 <> 0 THEN CAST(turn AS VARCHAR) END"),
         *[("locator", k, f"coalesce({_L.get(k, 'NULL')}, CASE WHEN label <> '' THEN {x} END)") for k, x in _V.items()]]
cte("atoms_open", " UNION ALL ".join(
    f"SELECT id, '{place}' AS place, '{key}' AS key, {x} AS value FROM atoms_parts WHERE ({x}) IS NOT NULL" for place, key, x in _OPEN),
    ("atoms_parts",))

cte("atoms_ui", f"""
SELECT id, deal_id, atom_type, confidence, calibrated_confidence,
       labelled AND (quality = 1 OR toxic = 0) AS verified,
       CASE WHEN labelled THEN CAST(quality AS VARCHAR) ELSE '' END AS receipt_kinds,
       authority_class, review_status, body AS raw_text,
       CASE WHEN body <> '' THEN body ELSE '' END AS normalized_text,
       CASE WHEN body <> '' THEN body ELSE v_text END AS value_text,
       CASE WHEN spk <> '' AND coalesce(speaker, '') = '' THEN spk ELSE speaker END AS value_speaker,
       CASE WHEN said <> '' AND coalesce(said_by, '') = '' THEN said ELSE said_by END AS value_said_by,
       'conv:' || CAST(conv_id AS VARCHAR) || ',role:' || role AS entity_keys,
       CASE WHEN label <> '' THEN label ELSE loc_section_path END AS section_path,
       coalesce(nullif(ref_artifact_id, ''), nullif(artifact_id, ''), '') AS source_artifact_id,
       coalesce(ref_filename, '') AS source_filename, coalesce(ref_method, '') AS extraction_method,
       CASE WHEN label <> '' THEN label ELSE loc_section_path END AS locator_section_path,
       CASE WHEN label <> '' AND spk <> '' AND coalesce(loc_speaker_eff, '') = '' THEN spk
            ELSE loc_speaker_eff END AS locator_speaker,
       CASE WHEN label <> '' AND coalesce(v_party, '') <> '' THEN v_party END AS locator_party,
       'v1' AS parser_version
FROM atoms_parts
""", ("atoms_parts",))

cte("stage_timings", r"""
SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS compile_id,
       ['parse_artifacts', 'classify', 'extract_entities', 'link_entities', 'source_replay', 'score',
        'project'][l_linenumber] AS stage_name,
       l_linenumber AS stage_no, l_partkey, l_suppkey, l_extendedprice AS duration_ms,
       CAST(l_quantity AS BIGINT) AS input_count,
       CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) AS output_count,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS warning_count,
       CAST(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 ELSE 0 END AS BIGINT) AS error_count
FROM lineitem
""")

cte("llm_calls", r"""
SELECT event_id AS call_id, compile_id, updated_at AS ts,
       CASE WHEN event_type = 'view' THEN 'multi' ELSE 'verify' END AS source,
       atom_count AS prompt_size, CAST(512 * (event_id % 4 + 1) AS BIGINT) AS max_tokens,
       CAST(atom_count * 10 + event_id % 7 AS BIGINT) AS response_size, elapsed_sec AS latency_sec,
       'm' || CAST(user_id % 2 AS VARCHAR) AS model
FROM status_events WHERE event_type IN ('view', 'click')
""", ("status_events",))

_DIRS = "['_head_registry', '_calibrator', '_type_head', '_span_heads'][doc_id % 4 + 1]"

cte("local_listing", f"""
SELECT {_DIRS} || '/h_' || CAST(doc_id AS VARCHAR) || '.npz' AS name, n_chars AS size
FROM documents WHERE doc_id % 5 <> 3
UNION ALL SELECT '_training_log.db', CAST(sum(n_chars) AS BIGINT) FROM documents
UNION ALL SELECT '_embed_cache.db', CAST(count(*) AS BIGINT) FROM documents
""")

cte("remote_listing", f"""
SELECT {_DIRS} || '/h_' || CAST(doc_id AS VARCHAR) || '.npz' AS name,
       n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size
FROM documents WHERE doc_id % 10 <> 4
""")

cte("sync_plan", r"""
SELECT name, split_part(name, '/', 1) AS dir, local_size, remote_size,
  CASE WHEN name IN ('_training_log.db', '_embed_cache.db') AND local_size IS NOT NULL THEN 'upload'
       WHEN local_size IS NOT NULL AND coalesce(remote_size = local_size, false) THEN 'skip'
       WHEN local_size IS NOT NULL THEN 'upload'
       WHEN split_part(name, '/', 1) = '_head_registry'
            AND (SELECT count(*) FROM local_listing WHERE split_part(name, '/', 1) = '_head_registry') > 0
            THEN 'delete'
       ELSE 'keep' END AS action,
  CASE name WHEN '_training_log.db' THEN 1 WHEN '_embed_cache.db' THEN 2 ELSE 0 END AS upload_order
FROM (SELECT coalesce(l.name, r.name) AS name, l.size AS local_size, r.size AS remote_size
      FROM local_listing l FULL OUTER JOIN remote_listing r ON l.name = r.name)
""", ("local_listing", "remote_listing"))

cte("fetch_names", r"""
SELECT CASE p_partkey % 8
         WHEN 0 THEN 'dataset/' || CAST(p_partkey AS VARCHAR) || '.json'
         WHEN 1 THEN 'a/' || CAST(p_partkey AS VARCHAR) || '.PNG'
         WHEN 2 THEN '_training_' || CAST(p_partkey AS VARCHAR) || '.db'
         WHEN 3 THEN CASE WHEN p_partkey = 3 THEN '_training_log.db'
                          ELSE 'x/_runpod_' || CAST(p_partkey AS VARCHAR) || '.bin' END
         WHEN 4 THEN '_head_registry/' || CAST(p_partkey AS VARCHAR) || '.npz'
         WHEN 5 THEN 'x_backup_' || CAST(p_partkey AS VARCHAR)
         WHEN 6 THEN 'heads/' || CAST(p_partkey AS VARCHAR) || '.pkl'
         ELSE 'z/' || CAST(p_partkey AS VARCHAR) || '.zip' END AS name,
       CAST(p_size AS BIGINT) AS size
FROM part
""")

cte("fetch_filter", r"""
SELECT name, NOT (CASE WHEN starts_with(lower(name), 'dataset/') OR lower(name) LIKE '%.png'
                            OR lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' OR lower(name) LIKE '%.zip'
                       THEN true
                       WHEN lower(name) = '_training_log.db' THEN false
                       WHEN contains(lower(name), '_training_') OR contains(lower(name), '_runpod_')
                            OR contains(lower(name), '_backup_') THEN true
                       WHEN starts_with(lower(name), '_head_registry/') THEN true
                       ELSE false END) AS fetched
FROM fetch_names
""", ("fetch_names",))

cte("artifact_config", r"""
SELECT 'K' || CAST(p_partkey AS VARCHAR) AS key,
       CASE p_partkey % 5
         WHEN 0 THEN '/tmp/ml/heads/' || CAST(p_partkey AS VARCHAR) || '.pkl'
         WHEN 1 THEN '/tmp/ml/heads/missing_' || CAST(p_partkey AS VARCHAR) || '.pkl'
         WHEN 2 THEN '/tmp/ml/nosrc/' || CAST(p_partkey AS VARCHAR) || '.bin'
         WHEN 3 THEN '/tmp/ml/cache/' || CAST(p_partkey AS VARCHAR) || '.db'
         ELSE '/var/other/' || CAST(p_partkey AS VARCHAR) END AS path
FROM part
""")

cte("config_check", r"""
SELECT key, path,
       CASE WHEN rel IN (SELECT name FROM fetch_filter WHERE fetched) THEN 'present'
            WHEN split_part(rel, '/', 1) IN (SELECT split_part(name, '/', 1) FROM fetch_filter) THEN 'missing'
            ELSE 'no_source' END AS state
FROM (SELECT key, path, substr(path, 9) AS rel,
             lower(string_split(path, '/')[-1] || '|' || path) AS low
      FROM artifact_config)
WHERE starts_with(path, '/tmp/ml/') AND path <> '/tmp/ml/'
  AND NOT (contains(low, 'cache') OR contains(low, '_shadow_history') OR contains(low, '_feedback')
           OR contains(low, '_rule_decisions'))
  AND NOT contains(low, '_head_registry')
""", ("artifact_config", "fetch_filter"))

cte("draft_inputs", r"""
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 13 = 0 THEN 'z' || substr(d, 2) ELSE d END AS deal_id,
       c_name || repeat('x', CAST(c_custkey % 150 AS INTEGER)) AS requested_by,
       'env-' || CAST(c_custkey AS VARCHAR) AS envelope_compile_id,
       c_custkey % 9 <> 0 AS has_brief, c_custkey % 5 <> 0 AS has_handoff,
       CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' WHEN 2 THEN 'failed' END AS draft_status,
       CASE WHEN c_custkey % 4 = 2 AND c_custkey % 8 = 2 THEN 'no sites found' END AS failed_because,
       CASE WHEN c_custkey % 4 = 2 AND c_custkey % 8 = 6 THEN 'boom' END AS error,
       CASE WHEN c_custkey % 4 IN (1, 2) THEN
            CASE c_custkey % 3 WHEN 0 THEN 'assumptions, scope' WHEN 1 THEN 'pricing' END END AS calls,
       CAST(c_custkey % 5 AS INTEGER) AS n_locations,
       CASE WHEN c_custkey % 2 = 0 THEN 'crm' END AS site_source,
       'fam' || CAST(c_custkey % 3 AS VARCHAR) AS job_family,
       CASE WHEN c_custkey % 6 <> 0 THEN 'model' END AS job_family_by,
       CASE WHEN c_custkey % 7 <> 0 THEN 'deal=' || CAST(c_custkey % 9 AS VARCHAR) || ',template='
            || CAST(c_custkey % 4 AS VARCHAR) END AS origin_counts
FROM (SELECT *, concat_ws('-', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8),
                          substr(md5(CAST(c_custkey AS VARCHAR)), 9, 4),
                          substr(md5(CAST(c_custkey AS VARCHAR)), 13, 4),
                          substr(md5(CAST(c_custkey AS VARCHAR)), 17, 4),
                          substr(md5(CAST(c_custkey AS VARCHAR)), 21, 12)) AS d
      FROM customer)
""")

cte("draft_summary", r"""
SELECT *,
  CASE WHEN st = 'failed' THEN left(coalesce(nullif(failed_because, ''), nullif(error, ''),
                                             'the SOW writer gave no reason'), 300) END AS s_failed_because,
  CASE WHEN st = 'degraded' THEN
       CASE WHEN calls IS NOT NULL THEN 'LLM call(s) ' || calls
                 || ' returned nothing usable; those steps ran without an answer'
            ELSE 'the SOW writer marked it degraded' END END AS s_degraded_because,
  replace(calls, ', ', ',') AS s_llm_failures
FROM (SELECT *, coalesce(nullif(draft_status, ''), CASE WHEN coalesce(error, '') <> '' THEN 'failed' END,
                         'unknown') AS st
      FROM draft_inputs)
""", ("draft_inputs",))

cte("active_markers_files", r"""
SELECT *, CAST(split_part(compile_id, '-', 1) AS BIGINT) % 11 <> 0 AND CAST(split_part(compile_id, '-', 1) AS BIGINT) % 13 <> 0 AS hash_ok FROM active_markers
""", ("active_markers",))
