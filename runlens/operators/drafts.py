"""P20-P22 draft summary and merge of a written draft into the envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEAL_ID_PATTERN = "^[0-9a-fA-F-]{36}\\z"
NO_BRIEF = "RuntimeError: the latest envelope has no brief; compile the deal first"


def draft_summary_cols(sow: Column) -> dict[str, Column]:
    """P20: status ok/degraded/failed/unknown, failed_because,
    degraded_because, sorted distinct failing calls, pass-through fields."""
    status = F.coalesce(F.nullif(sow["draft_status"], F.lit("")),
                        F.when(F.coalesce(sow["error"], F.lit("")) != "", F.lit("failed")),
                        F.lit("unknown"))
    calls = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.coalesce(sow["llm_failures"], F.array()), lambda f: f["call"]),
        lambda c: c.isNotNull() & (c != ""))))
    return {
        "draft_status": status,
        "failed_because": F.when(status == "failed", F.left(F.coalesce(
            F.nullif(sow["failed_because"], F.lit("")), F.nullif(sow["error"], F.lit("")),
            F.lit("the SOW writer gave no reason")), F.lit(300))),
        "degraded_because": F.when(status == "degraded", F.when(
            F.size(calls) > 0,
            F.concat(F.lit("LLM call(s) "), F.array_join(calls, ", "),
                     F.lit(" returned nothing usable; those steps ran without an answer")))
            .otherwise(F.lit("the SOW writer marked it degraded"))),
        "llm_failures": F.when(F.size(calls) > 0, F.array_join(calls, ",")),
        "site_source": sow["site_source"],
        "job_family": sow["job_family"],
        "job_family_by": sow["job_family_by"],
        "origin_counts": F.array_join(F.transform(F.array_sort(F.map_entries(sow["origin_counts"])),
                                                  lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
    }


def draft_summary(drafts: DataFrame) -> DataFrame:
    cols = draft_summary_cols(F.col("draft_doc"))
    return drafts.select("deal_id", *[c.alias(n) for n, c in cols.items()])


def _joined(requests: DataFrame, envelopes: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Valid requests with their deal's envelope and, if any, its handoff."""
    valid = requests.where(F.col("deal_id").rlike(DEAL_ID_PATTERN))
    env = envelopes.select("deal_id", F.col("compile_id").alias("envelope_compile_id"),
                           (F.coalesce(F.col("brief"), F.lit("")) != "").alias("has_brief"))
    return (valid.join(env, "deal_id", "left")
                 .join(handoffs.select("deal_id", F.lit(True).alias("has_handoff")), "deal_id", "left")
                 .withColumn("has_brief", F.coalesce("has_brief", F.lit(False)))
                 .withColumn("has_handoff", F.coalesce("has_handoff", F.lit(False))))


def merged_documents(requests: DataFrame, envelopes: DataFrame, handoffs: DataFrame) -> DataFrame:
    """The envelope of each drafted deal, and its handoff when there is
    one, with the draft in it (rows for the upsert sink)."""
    j = _joined(requests, envelopes, handoffs).where("has_brief")
    kinds = F.filter(F.array(F.lit("envelope"), F.when(F.col("has_handoff"), F.lit("handoff"))), lambda k: k.isNotNull())
    return j.select(F.explode(kinds).alias("document"), "deal_id", F.col("envelope_compile_id").alias("compile_id"),
                    F.lit("draft_run").alias("written_on"), F.to_json("draft_doc").alias("draft"))


DRAFT_ERROR_MAX = 200


def failed_drafts(errors: DataFrame) -> DataFrame:
    """P11 + P21: the status row of a draft whose writer failed; the message is
    cut, its type is not. ``errors``: request_id, deal_id, error_type, message."""
    said = F.concat(F.col("error_type"), F.lit(": "), F.left(F.coalesce("message", F.lit("")), F.lit(DRAFT_ERROR_MAX)))
    return errors.select("request_id", "deal_id", F.lit("failed").alias("state"), said.alias("error"),
                         F.lit("failed").alias("draft_status"), said.alias("failed_because"))


def draft_merge(requests: DataFrame, envelopes: DataFrame, handoffs: DataFrame) -> DataFrame:
    """P21 + P22: requests with a malformed deal id produce nothing; a deal
    whose envelope has no brief fails; otherwise the draft is written
    into the envelope (and the handoff when one exists) and the status row
    carries the envelope's compile id, location count and summary."""
    valid = _joined(requests, envelopes, handoffs)
    ok = F.col("has_brief")
    s = draft_summary_cols(F.col("draft_doc"))
    return valid.select(
        "request_id", "deal_id", F.left(F.coalesce("requested_by", F.lit("")), F.lit(120))
        .alias("requested_by"),
        F.when(ok, "done").otherwise("failed").alias("state"),
        F.when(ok, F.col("envelope_compile_id")).alias("compile_id"),
        F.when(ok, F.size(F.coalesce(F.col("draft_doc.locations"), F.array()))).alias("locations"),
        F.when(ok, s["draft_status"]).otherwise("failed").alias("draft_status"),
        F.when(ok, s["failed_because"]).otherwise(F.lit(NO_BRIEF)).alias("failed_because"),
        F.when(ok, s["degraded_because"]).alias("degraded_because"),
        F.when(ok, s["llm_failures"]).alias("llm_failures"),
        F.when(ok, s["origin_counts"]).alias("origin_counts"),
        F.when(~ok, F.lit(NO_BRIEF)).alias("error"),
        F.when(ok, F.lit("draft_run")).alias("written_on"),
        (ok & F.col("has_handoff")).alias("handoff_updated"))
