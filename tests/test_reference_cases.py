"""The reference's unit-test expectations restated as DataFrame cases."""

import base64
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from runlens.operators import admission as A
from runlens.operators import drafts as DR
from runlens.operators import health as H
from runlens.operators import status as S
from runlens.operators.fingerprint import manifest_key, unchanged_jobs


def _decode(spark, docs):
    rows = [Row(message_id=i, lane="normal", received_at=None, dequeue_count=1,
                content=d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "message_id long, lane string, received_at timestamp, "
                                     "dequeue_count int, content string")
    return {r.message_id: r for r in A.decode_messages(df).collect()}


BASE = {"compile_id": "c", "deal_id": "d", "manifest_blob_url": "https://a/b/c"}


def test_requester_precedence(spark):
    cases = [
        ({"triggered_by": "ann"}, "ann", None),
        ({"triggeredBy": "bo"}, "bo", None),
        ({"trigger": {"kind": "manual", "by": "x"}}, "x", "manual"),
        ({"trigger": {"kind": "timer"}}, "timer", "timer"),
        ({"triggered_by": "   "}, None, None),
        ({"trigger": {}}, None, None),
        ({"triggered_by": "flat", "trigger": {"kind": "timer"}}, "flat", "timer"),
        ({"triggered_by": "   ", "triggeredBy": "camel"}, None, None),
    ]
    out = _decode(spark, [{**BASE, **c} for c, _, _ in cases])
    for i, (_, who, kind) in enumerate(cases):
        assert out[i].triggered_by == who, (i, out[i])
        assert out[i].trigger_kind == kind, (i, out[i])


def test_decode_json_base64_and_errors(spark):
    good = json.dumps(BASE)
    b64 = base64.b64encode(good.encode()).decode()
    out = _decode(spark, [good, "  " + good + " ", b64, b64.rstrip("="), "[1]", "{bad",
                          json.dumps({"deal_id": "d", "manifest_blob_url": "u"}),
                          json.dumps({**BASE, "compile_id": None}),
                          json.dumps({**BASE, "trigger": "oops"}),
                          json.dumps({**BASE, "force": "false"}),
                          json.dumps({**BASE, "compile_options": {"force": 1}}),
                          json.dumps({**BASE, "kind": "sow_draft"})])
    assert out[0].job_ok and out[1].job_ok and out[2].job_ok
    assert out[3].job_ok == (len(b64.rstrip("=")) % 4 == 0)
    assert not out[4].decoded and not out[5].decoded
    assert out[6].decoded and not out[6].job_ok          # missing compile_id
    assert out[7].job_ok and out[7].compile_id == "None"  # JSON null -> 'None'
    assert not out[8].job_ok                              # non-object trigger
    assert out[9].force and out[10].force                 # truthiness
    assert out[11].route == "draft" and out[0].route == "compile"


def test_budget_per_deal(spark):
    df = spark.createDataFrame([(9,), (68,), (120,), (100000,), (None,)], "n int")
    got = [r.b for r in df.select(A.budget_sec(F.col("n")).alias("b")).collect()]
    assert got == [1500.0, 3060.0, 5400.0, 10800.0, 1500.0]


def test_unchanged_scope_rules(spark):
    cur = spark.createDataFrame(
        [("same", "k", "2026-01-01", False), ("cut_vs_full", "k", None, False),
         ("full_vs_cut", "k", "2026-01-01", False), ("legacy_full", "k", None, False),
         ("legacy_cut", "k", "2026-01-01", False), ("changed", "k2", None, False),
         ("new", "k", None, False), ("forced", "k", None, True)],
        "deal_id string, artifact_key string, as_of string, force boolean")
    st = spark.createDataFrame(
        [("same", "k", " 2026-01-01 "), ("cut_vs_full", "k", "2026-01-01"), ("full_vs_cut", "k", None),
         ("legacy_full", "k", None), ("legacy_cut", "k", None), ("changed", "k", None),
         ("forced", "k", None)], "deal_id string, artifact_key string, as_of string")
    got = {r.deal_id: (r.unchanged, r.decision) for r in unchanged_jobs(cur, st).collect()}
    assert got["same"] == (True, "skip_unchanged")
    assert got["cut_vs_full"][0] is False and got["full_vs_cut"][0] is False
    assert got["legacy_full"][0] is True and got["legacy_cut"][0] is False
    assert got["changed"][0] is False and got["new"] == (False, "compile")
    assert got["forced"] == (True, "compile")


def test_manifest_key_matches_python(spark):
    import hashlib
    hashes = ["b", None, "a", "b"]
    expect = hashlib.sha256("\n".join(sorted(str(h or "") for h in hashes)).encode()).hexdigest()
    df = spark.createDataFrame([(hashes,)], "h array<string>")
    assert df.select(manifest_key(F.col("h")).alias("k")).first().k == expect


def test_rerun_block_only_same_compile_and_final_stages(spark):
    jobs = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",), ("c5",)], "compile_id string")
    ev = spark.createDataFrame(
        [("c1", "failed", "timeout", 1), ("c2", "failed", "killed", 1),
         ("c3", "failed", "exception", 1), ("c4", "running", "parse", 1),
         ("c5", "failed", "out_of_memory", 1), ("c5", "completed", "done", 2)],
        "compile_id string, status string, stage string, seq long").withColumn(
        "updated_at", F.timestamp_seconds(F.col("seq"))).withColumn("deal_id", F.lit("d"))
    got = {r.compile_id: r.blocked_stage for r in A.previous_final(jobs, ev).collect()}
    assert got == {"c1": "timeout", "c2": "killed", "c3": None, "c4": None, "c5": None}


def _status(spark, rows):
    return spark.createDataFrame(rows, "compile_id string, deal_id string, status string, "
                                       "stage string, seq long, error string").select(
        "*", F.timestamp_seconds(F.lit(1767225600) + F.col("seq")).alias("updated_at"),
        F.lit(1.5).alias("elapsed_sec"), F.lit(1).cast("bigint").alias("atom_count"),
        F.lit(1).cast("bigint").alias("entity_count"), F.lit(1).alias("percent_complete"),
        F.lit("w").alias("worker_sha"), F.lit("p").alias("parser_sha"))


def test_run_index_rules(spark):
    ev = _status(spark, [("a", "d", "completed", "done", 1, None),
                         ("b", "d", "failed", "exception", 2, "x" * 900),
                         ("c", "d", "running", "parse", 3, None),
                         ("e", "d", "interrupted", "terminated", 4, None),
                         ("f", "d", "cancelled", "cancelled", 5, None),
                         ("g" * 300, "exceptión\n", "completed", "done", 6, None)])
    idx = {r.compile_id: r for r in S.run_index(ev).collect()}
    assert set(idx) == {"a", "b", "e", "g" * 300}
    assert idx["a"].run_date == "2026-01-01"
    assert len(idx["b"].error) == 500 and idx["b"].error.endswith("…")
    assert len(idx["g" * 300].meta_compile_id) == 128
    assert idx["g" * 300].meta_deal_id == "exceptin"


def test_dead_runs_and_ownership(spark):
    markers = spark.createDataFrame(
        [("c1", "d1", "source_replay", "r0", "b1"), ("c2", "d2", None, "r0", "b2"),
         ("c3", "d3", "parse", "r1", "b0"), ("c4", "d4", None, "r0", "b0")],
        "compile_id string, deal_id string, stage string, replica string, boot_id string"
    ).withColumn("updated_at", F.current_timestamp())
    boots = spark.createDataFrame(
        [("r0", "b1", 1), ("r0", "b2", 2), ("r1", "b0", 1)], "replica string, boot_id string, t long"
    ).select("replica", "boot_id", F.timestamp_seconds("t").alias("booted_at"))
    prog = spark.createDataFrame(
        [("d1", "c1", "source_replay", 4283, 16001, 1), ("d4", "c9", "classify", 1, 2, 1)],
        "deal_id string, compile_id string, current_stage string, stage_items_done long, "
        "stage_items_total long, seq long").withColumn("updated_at", F.timestamp_seconds("seq"))
    prog = prog.select("*", F.lit('["parse"]').alias("stages"), F.lit("2024-01-01").alias("started_at"),
                       F.lit(3).cast("bigint").alias("stage_count_done"), F.lit(9).cast("bigint").alias("stage_count_total_estimate"),
                       F.lit("pm").alias("triggered_by"), F.lit("manual").alias("trigger_kind"))
    dead = {r.compile_id: r for r in H.dead_runs(markers, boots, prog).collect()}
    assert set(dead) == {"c1", "c4"}              # other replica / current boot are left
    assert "source_replay at 4,283 of 16,001 items" in dead["c1"].error
    req = H.dead_runs(markers, boots, prog).select("deal_id", "compile_id",
                                                   F.lit("killed").alias("stage"), "error")
    g = {r.compile_id: r for r in H.guarded_fail(req, prog).collect()}
    assert g["c1"].written and g["c1"].failed_stage == "source_replay" and g["c1"].current_stage is None
    assert (g["c1"].stages, g["c1"].started_at, g["c1"].stage_count_done, g["c1"].stage_count_total_estimate, g["c1"].triggered_by,
            g["c1"].trigger_kind, g["c1"].stage_items_done, g["c1"].stage_items_total) == (
        '["parse"]', "2024-01-01", 3, 9, "pm", "manual", 4283, 16001)
    assert not g["c4"].written                    # a newer compile owns the deal


def test_memory_ceiling(spark):
    gib = 1 << 30
    s = spark.createDataFrame(
        [("a", int(7.5 * gib), 8 * gib, 0.9, 1), ("b", 2 * gib, 8 * gib, 0.9, 1),
         ("c", 5 * gib, 10 * gib, 0.5, 1), ("d", 9 * gib, 8 * gib, 0.0, 1)],
        "compile_id string, rss_bytes long, limit_bytes long, fraction double, seq long"
    ).withColumn("sampled_at", F.timestamp_seconds("seq")).withColumn("deal_id", F.lit("x"))
    progress = "deal_id string, updated_at timestamp, seq long, current_stage string, stage_items_done long, stage_items_total long"
    got = {r.compile_id: r.error for r in H.oom_first_hit(s, spark.createDataFrame([], progress)).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].startswith("The parse ran out of memory: 7.5 GB used of the worker's 8.0 GB.")
    at = spark.sql("SELECT 'x' AS deal_id, timestamp_seconds(1) AS updated_at, 1L AS seq, 'parse' AS current_stage, 1200L AS stage_items_done, 16001L AS stage_items_total")
    got = {r.compile_id: r.error for r in H.oom_first_hit(s, at).collect()}
    assert got["c"].startswith("The parse ran out of memory in parse at 1,200 of 16,001 items: 5.0 GB used of the worker's 10.0 GB.")


def test_terminal_wins(spark):
    ev = spark.createDataFrame(
        [("c", "running", 1), ("c", "completed", 2), ("c", "running", 3), ("k", "running", 1)],
        "compile_id string, status string, seq long").withColumn(
        "updated_at", F.timestamp_seconds("seq"))
    kept = sorted((r.compile_id, r.seq) for r in H.terminal_wins(ev).collect())
    assert kept == [("c", 1), ("c", 2), ("k", 1)]


def test_cancel_match(spark):
    active = spark.createDataFrame([("d1", "c1", 1), ("d2", "c2", 1)],
                                   "deal_id string, compile_id string, t long").withColumn(
        "updated_at", F.timestamp_seconds("t"))
    req = spark.createDataFrame([(1, "d1", "c1"), (2, "d1", "other"), (3, "d2", None), (4, "d3", None)],
                                "request_id long, deal_id string, compile_id string")
    got = {r.request_id: r.cancelled_run for r in H.cancel_match(req, active).collect()}
    assert got == {1: "c1", 2: None, 3: "c2", 4: None}


def test_draft_summary_and_merge(spark):
    t = "struct<draft_status:string,failed_because:string,error:string," \
        "llm_failures:array<struct<call:string,tries:int>>,locations:array<struct<site:string>>," \
        "site_source:string,job_family:string,job_family_by:string,origin_counts:map<string,bigint>>"
    good = "0" * 8 + "-" + "a" * 4 + "-" + "b" * 4 + "-" + "c" * 4 + "-" + "d" * 12
    rows = [
        (1, good, "pm", "env", True, True, (None, None, None, None, [], None, None, None, None)),
        (2, good, "pm", "env", True, False, ("degraded", None, None,
                                              [("assumptions", 1), ("scope", 1), ("assumptions", 2)],
                                              [("s",)], None, None, None, {"template": 2, "deal": 1})),
        (3, good, "pm", "env", True, True, ("failed", None, "boom", None, [], None, None, None, None)),
        (4, good, "pm", "env", False, True, ("ok", None, None, None, [], None, None, None, None)),
        (5, "not-a-uuid", "pm", "env", True, True, ("ok", None, None, None, [], None, None, None, None)),
    ]
    df = spark.createDataFrame(rows, f"request_id long, deal_id string, requested_by string, "
                                     f"envelope_compile_id string, has_brief boolean, "
                                     f"has_handoff boolean, draft_doc {t}")
    df = df.withColumn("deal_id", F.when(F.col("request_id") < 5, F.concat(
        F.substr("deal_id", F.lit(1), F.lit(35)), F.col("request_id").cast("string"))).otherwise(F.col("deal_id")))
    tables = (df.select("request_id", "deal_id", "requested_by", "draft_doc"),
              df.select("deal_id", F.col("envelope_compile_id").alias("compile_id"), F.when(F.col("has_brief"), "b").alias("brief")),
              df.where("has_handoff").select("deal_id"))
    got = {r.request_id: r for r in DR.draft_merge(*tables).collect()}
    merged = sorted((r.document, r.deal_id[-1]) for r in DR.merged_documents(*tables).collect())
    assert merged == [("envelope", "1"), ("envelope", "2"), ("envelope", "3"), ("handoff", "1"), ("handoff", "3")]
    assert got[2].origin_counts == "deal=1,template=2" and got[2].handoff_updated is False
    assert 5 not in got
    assert got[1].draft_status == "unknown"
    assert "assumptions, scope" in got[2].degraded_because and got[2].llm_failures == "assumptions,scope"
    assert got[3].failed_because == "boom"
    assert got[4].state == "failed" and "brief" in got[4].error
