"""Atoms, counts, traces and drafts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runlens.operators import atoms as AT
from runlens.operators import traces as TR
from runlens.plans.oracle_ctes import with_ctes
from runlens.plans.registry import register
from runlens.session import checkpoint_path
from runlens.sources.derived import Derived, atoms_raw


def ui(spark, sf_dir):
    return AT.flatten_atoms(atoms_raw(Derived(spark, sf_dir)))


_UI_COLS = ("id, deal_id, atom_type, confidence, calibrated_confidence, verified, receipt_kinds, "
            "authority_class, review_status, raw_text, normalized_text, value_text, value_speaker, "
            "value_said_by, entity_keys, section_path, source_artifact_id, source_filename, "
            "extraction_method, locator_section_path, locator_speaker, locator_party, parser_version")


@register("atoms_ui", with_ctes(f"SELECT {_UI_COLS} FROM atoms_ui", "atoms_ui"))
def q_atoms_ui(spark, sf_dir):
    return AT.picked(ui(spark, sf_dir))


@register("atoms_verified", with_ctes("SELECT id, verified, receipt_kinds FROM atoms_ui", "atoms_ui"))
def q_atoms_verified(spark, sf_dir):
    return ui(spark, sf_dir).select("id", "verified", "receipt_kinds")


@register("atoms_speaker", with_ctes(
    "SELECT id, section_path, locator_section_path, locator_speaker, locator_party FROM atoms_ui",
    "atoms_ui"))
def q_atoms_speaker(spark, sf_dir):
    return ui(spark, sf_dir).select("id", "section_path", "locator_section_path",
                                    "locator_speaker", "locator_party")


@register("atoms_body", with_ctes(
    "SELECT id, raw_text, value_text, value_speaker, value_said_by FROM atoms_ui", "atoms_ui"))
def q_atoms_body(spark, sf_dir):
    return ui(spark, sf_dir).select("id", "raw_text", "value_text", "value_speaker",
                                    "value_said_by")


@register("atoms_by_type", with_ctes(
    "SELECT atom_type, count(*) AS atoms FROM atoms_ui GROUP BY atom_type", "atoms_ui"))
def q_atoms_by_type(spark, sf_dir):
    return AT.atoms_by_type(ui(spark, sf_dir))


@register("atoms_by_artifact", with_ctes(r"""
SELECT file, atom_type, count(*) AS atoms
FROM (SELECT CASE WHEN source_filename <> '' THEN source_filename ELSE '(unknown)' END AS file, atom_type
      FROM atoms_ui)
GROUP BY GROUPING SETS ((file), (file, atom_type))""", "atoms_ui"))
def q_atoms_by_artifact(spark, sf_dir):
    return AT.atoms_by_artifact(ui(spark, sf_dir))


@register("extract_atoms", r"""
SELECT doc_id, line_no,
       CASE WHEN length(line) < 40 THEN 'short' WHEN length(line) < 200 THEN 'medium' ELSE 'long' END
         AS atom_type,
       length(line) AS n_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS line_no
      FROM documents)
WHERE trim(line) <> ''""")
def q_extract_atoms(spark, sf_dir):
    return AT.extract_line_atoms(Derived(spark, sf_dir).t("documents"))


@register("run_counts", with_ctes(r"""
SELECT b.deal_id, count(*) AS atoms, count(DISTINCT (b.conv_id, b.role)) AS entities,
       count(DISTINCT b.conv_id) AS packets, count(n.conv_id) AS edges
FROM atoms_raw b LEFT JOIN (SELECT conv_id, turn - 1 AS turn FROM atoms_raw) n USING (conv_id, turn)
GROUP BY b.deal_id""", "atoms_raw"))
def q_run_counts(spark, sf_dir):
    return AT.run_counts(atoms_raw(Derived(spark, sf_dir)))


@register("envelope_rollup", with_ctes(r"""
SELECT deal_id, count(*) AS atoms, count(*) FILTER (WHERE verified) AS verified_atoms,
       string_agg(DISTINCT atom_type, ',' ORDER BY atom_type) AS atom_types
FROM atoms_ui GROUP BY deal_id""", "atoms_ui"))
def q_envelope_rollup(spark, sf_dir):
    return AT.envelope_rollup(ui(spark, sf_dir))


@register("draft_markdown", with_ctes(r"""
SELECT deal_id, md AS markdown, 'v1' AS version, length(md) AS n_chars
FROM (SELECT r.deal_id,
             '# Draft for ' || r.deal_id || chr(10) || 'Atoms: ' || CAST(r.atoms AS VARCHAR) || ' (verified '
             || CAST(r.verified_atoms AS VARCHAR) || ')' || chr(10) || l.lines AS md
      FROM (SELECT deal_id, count(*) AS atoms, count(*) FILTER (WHERE verified) AS verified_atoms
            FROM atoms_ui GROUP BY deal_id) r
      JOIN (SELECT deal_id, string_agg(line, chr(10) ORDER BY line) AS lines
            FROM (SELECT deal_id, '- ' || atom_type || ': ' || CAST(count(*) AS VARCHAR) AS line
                  FROM atoms_ui GROUP BY deal_id, atom_type)
            GROUP BY deal_id) l USING (deal_id))""", "atoms_ui"))
def q_draft_markdown(spark, sf_dir):
    u = ui(spark, sf_dir)
    by_type = u.groupBy("deal_id", "atom_type").agg(F.count(F.lit(1)).alias("atoms"))
    return AT.draft_markdown(AT.envelope_rollup(u), by_type)


@register("llm_summary", with_ctes(r"""
SELECT compile_id, source, model, count(*) AS calls, round(sum(latency_sec), 3) AS latency_sec
FROM llm_calls GROUP BY GROUPING SETS ((compile_id), (compile_id, source), (compile_id, model))""",
    "llm_calls"))
def q_llm_summary(spark, sf_dir):
    return TR.llm_summary(Derived(spark, sf_dir).llm_calls())


@register("stage_timeline", with_ctes(r"""
SELECT compile_id, pos, stage_name, round(duration_ms, 3) AS duration_ms,
       round(run_ms - duration_ms, 3) AS start_ms, input_count, output_count, warning_count, error_count
FROM (SELECT *, row_number() OVER w AS pos,
             sum(duration_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_ms
      FROM stage_timings
      WINDOW w AS (PARTITION BY compile_id ORDER BY stage_no, l_partkey, l_suppkey, duration_ms))""",
    "stage_timings"))
def q_stage_timeline(spark, sf_dir):
    return TR.stage_timeline(Derived(spark, sf_dir).stage_timings())


_LONGEST = r"""
SELECT compile_id, stage_name, duration_ms, total_ms, duration_ms / total_ms AS share
FROM (SELECT compile_id, stage_name, duration_ms, sum(duration_ms) OVER (PARTITION BY compile_id) AS total_ms
      FROM stage_timings
      QUALIFY row_number() OVER (PARTITION BY compile_id ORDER BY duration_ms DESC, stage_name DESC) = 1)"""


@register("longest_stage", with_ctes(
    f"SELECT compile_id, stage_name, duration_ms, round(share, 6) AS share FROM ({_LONGEST})",
    "stage_timings"))
def q_longest_stage(spark, sf_dir):
    r = TR.run_stage_totals(Derived(spark, sf_dir).stage_timings())
    return r.select("compile_id", "stage_name", "duration_ms", F.round("share", 6).alias("share"))


@register("stage_profile", with_ctes(f"""
SELECT stage_name, count(*) AS runs_longest,
       round(count(*) / (SELECT count(DISTINCT compile_id) FROM stage_timings), 6) AS share_of_runs
FROM ({_LONGEST}) GROUP BY stage_name""", "stage_timings"))
def q_stage_profile(spark, sf_dir):
    return TR.stage_profile(TR.run_stage_totals(Derived(spark, sf_dir).stage_timings()))


@register("longest_share_median", with_ctes(
    f"SELECT count(*) AS runs, round(median(share), 9) AS median FROM ({_LONGEST})", "stage_timings"))
def q_longest_share_median(spark, sf_dir):
    r = TR.run_stage_totals(Derived(spark, sf_dir).stage_timings())
    m = TR.exact_median(r, "share")
    return m.select("runs", F.round("median", 9).alias("median"))


@register("trace_diff", with_ctes(r"""
WITH s AS (SELECT compile_id, 'stage:' || stage AS item, count(*) AS n FROM status_events GROUP BY 1, 2
           UNION ALL
           SELECT compile_id, 'call:' || source || '/' || model AS item, count(*) AS n FROM llm_calls GROUP BY 1, 2),
     p AS (SELECT DISTINCT compile_id,
                  CAST(user_id AS VARCHAR) || '-' || strftime(updated_at - INTERVAL 1 DAY, '%Y%m%d') AS prev_compile_id
           FROM status_events
           WHERE CAST(user_id AS VARCHAR) || '-' || strftime(updated_at - INTERVAL 1 DAY, '%Y%m%d')
                 IN (SELECT compile_id FROM status_events)),
     a AS (SELECT p.compile_id, p.prev_compile_id, s.item, s.n FROM p JOIN s USING (compile_id)),
     b AS (SELECT p.compile_id, p.prev_compile_id, s.item, s.n FROM p JOIN s ON s.compile_id = p.prev_compile_id)
SELECT compile_id, prev_compile_id, count(*) FILTER (WHERE NOT coalesce(a.n = b.n, false)) AS differing_items,
       count(*) FILTER (WHERE NOT coalesce(a.n = b.n, false)) = 0 AS same_pipeline
FROM a FULL OUTER JOIN b USING (compile_id, prev_compile_id, item)
GROUP BY compile_id, prev_compile_id""", "status_events", "llm_calls"))
def q_trace_diff(spark, sf_dir):
    d = Derived(spark, sf_dir)
    ev = d.status_events()
    prev = F.concat(F.regexp_extract("compile_id", "^(.*)-", 1), F.lit("-"),
                    F.date_format(F.col("updated_at") - F.expr("INTERVAL 1 DAY"), "yyyyMMdd"))
    runs = ev.select("compile_id").distinct()
    pairs = (ev.select("compile_id", prev.alias("prev_compile_id")).distinct()
               .join(runs.withColumnRenamed("compile_id", "prev_compile_id"), "prev_compile_id",
                     "left_semi"))
    return TR.trace_diff(TR.trace_summary(ev, d.llm_calls()), pairs)


@register("atoms_by_artifact_nested", with_ctes(r"""
SELECT file, CAST(sum(n) AS BIGINT) AS atom_count, string_agg(atom_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY
       atom_type || ':' || CAST(n AS VARCHAR)) AS by_type_text
FROM (SELECT CASE WHEN source_filename <> '' THEN source_filename ELSE '(unknown)' END AS file,
             atom_type, count(*) AS n
      FROM atoms_ui GROUP BY 1, 2)
GROUP BY file""", "atoms_ui"))
def q_atoms_by_artifact_nested(spark, sf_dir):
    return AT.atoms_by_artifact_nested(ui(spark, sf_dir)).drop("by_type")


@register("extract_calls", f"""
SELECT doc_id, '{AT.CALL_SOURCE}' AS source, length(text) AS prompt_size, CAST({AT.CALL_MAX_TOKENS} AS BIGINT) AS max_tokens,
       CAST(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> ''), lambda l: length(l))) AS BIGINT) AS response_size,
       '{AT.CALL_MODEL}' AS model, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')) AS atoms
FROM documents WHERE trim(replace(text, chr(10), ''), ' ') <> ''""")
def q_extract_calls(spark, sf_dir):
    """An extractor's call rows beside its atoms, from one run over the documents."""
    def extract(pdf):
        import time

        import pandas as pd
        atoms, calls = [], []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            began = time.perf_counter()
            lines = [line for line in (text or "").split("\n") if line.strip(" ")]
            if lines:
                atoms += [(doc_id, len(line)) for line in lines]
                calls.append((doc_id, AT.CALL_SOURCE, len(text), AT.CALL_MAX_TOKENS, sum(map(len, lines)), time.perf_counter() - began, AT.CALL_MODEL))
        return pd.DataFrame(atoms, columns=["doc_id", "n_chars"]), pd.DataFrame(
            calls, columns=["doc_id", "source", "prompt_size", "max_tokens", "response_size", "latency_sec", "model"])
    docs = Derived(spark, sf_dir).t("documents").select("doc_id", "text")
    atoms, calls = AT.extract_with_calls(docs, extract, "doc_id long, n_chars long", checkpoint_path(spark, f"extract-{uuid.uuid4().hex[:12]}"))
    per = atoms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("atoms"))
    return calls.where("latency_sec >= 0").drop("latency_sec").join(per, "doc_id")


@register("draft_failures", with_ctes("""
SELECT error_id AS request_id, deal_id, 'failed' AS state, error_type || ': ' || left(traceback, 200) AS error, 'failed' AS draft_status,
       error_type || ': ' || left(traceback, 200) AS failed_because FROM errors""", "errors"))
def q_draft_failures(spark, sf_dir):
    from runlens.operators.drafts import failed_drafts
    return failed_drafts(Derived(spark, sf_dir).errors().select(F.col("error_id").alias("request_id"), "deal_id", "error_type",
                                                                F.col("traceback").alias("message")))
