"""File-source and sink queries (S2, S3, S5, S13, S14): the inputs are
files Spark writes from the driver tables into the shared folder once per
session, then read back through the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators.fingerprint import resolve_artifacts
from runlens.operators.status import run_index
from runlens.plans.oracle_ctes import with_ctes
from runlens.plans.registry import register
from runlens.session import written_once
from runlens.sources import documents as DO
from runlens.sources import files as FS
from runlens.sources import manifests as MA
from runlens.sources import objects as OB
from runlens.sources import versioned as VE
from runlens.sources.derived import Derived

def _files(spark, sf_dir, name, write) -> str:
    return written_once(spark, name, sf_dir, write)


@register("manifest_source", with_ctes(r"""
SELECT deal_id, pos, src AS source_url, ltrim(ltrim(rel, '/'), '\') AS rel_path, content_sha256
FROM (SELECT *, coalesce(nullif(blob_url, ''), nullif(url, '')) AS src,
             coalesce(nullif(filename, ''), nullif(path, ''), nullif(name, '')) AS rel
      FROM artifacts)
WHERE src IS NOT NULL AND rel IS NOT NULL""", "artifacts"))
def q_manifest_source(spark, sf_dir):
    def write(path):
        (Derived(spark, sf_dir).artifacts().withColumn("bucket", FS.bucket_of("deal_id", FS.ENVELOPE_BUCKETS))
         .write.mode("overwrite").partitionBy("bucket").json(path))
    path = _files(spark, sf_dir, "manifests", write)
    return resolve_artifacts(FS.read_manifest_entries(spark, path))


@register("marker_scan", with_ctes(r"""
SELECT compile_id, deal_id, replica, boot_id FROM active_markers_files
WHERE hash_ok""", "active_markers_files"))
def q_marker_scan(spark, sf_dir):
    def write(path):
        m = Derived(spark, sf_dir).active_markers()
        u = F.substring_index("compile_id", "-", 1).cast("bigint")
        doc = F.to_json(F.struct("compile_id", "deal_id", "stage",
                                 F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                                 .alias("updated_at"), "replica", "boot_id"))
        line = (F.when(u % 11 == 0, F.left(doc, F.lit(12)))                  # torn writes
                 .when(u % 13 == 0, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc))
        m.select(line.alias("value")).write.mode("overwrite").text(path)
    path = _files(spark, sf_dir, "markers", write)
    return FS.read_markers(spark, path).select("compile_id", "deal_id", "replica", "boot_id")


# What the object store holds of every page: nothing, a byte changed, cut short, or all of it.
_OBJECTS = """
SELECT 'deal' || (page_id % 20) AS deal_id, page_id, octet_length(encode(html)) AS size,
       CASE WHEN page_id % 50 = 0 THEN 'missing' WHEN page_id % 43 = 0 THEN 'size_differs'
            WHEN page_id % 41 = 0 THEN 'digest_differs' ELSE 'ok' END AS state
FROM pages WHERE length(html) > 1"""


def _objects(spark, sf_dir):
    """(manifest, folder): the pages as objects of their deals, some damaged;
    every tenth page is also rendered as a sheet."""
    k = F.col("page_id")
    pages = Derived(spark, sf_dir).t("pages").where(F.length("html") > 1)
    deal = F.concat(F.lit("deal"), (k % 20).cast("string"))
    page = pages.select(deal.alias("deal_id"), "page_id", "html", F.concat(deal, F.lit("/p "), k.cast("string"), F.lit(".html")).alias("rel_path"))
    held = (F.when(k % 43 == 0, F.left("html", F.floor(F.length("html") / 2).cast("int")))
             .when(k % 41 == 0, F.concat(F.left("html", F.length("html") - 1), F.lit("~"))).otherwise(F.col("html")))

    def write(path):
        stored = page.where("page_id % 50 <> 0").select("rel_path", held.cast("binary").alias("content"))
        sheets = pages.where("page_id % 10 = 3").select(
            F.concat(deal, F.lit("/sheets/s"), k.cast("string"), F.lit(".sheet.svg")).alias("rel_path"), F.col("html").cast("binary").alias("content"))
        OB.write_objects(stored.unionByName(sheets), path)
    manifest = page.select("deal_id", "rel_path", F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("content_sha256"))
    return manifest, _files(spark, sf_dir, "objects", write)


@register("artifact_bytes", f"""
SELECT deal_id, count(*) AS documents, CAST(coalesce(sum(size) FILTER (WHERE state = 'ok'), 0) AS BIGINT) AS bytes,
       count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state IN ('size_differs', 'digest_differs')) AS damaged
FROM ({_OBJECTS}) GROUP BY deal_id""")
def q_artifact_bytes(spark, sf_dir):
    """S3: contents met with the manifest by path, size and digest."""
    manifest, folder = _objects(spark, sf_dir)
    checked = OB.check_objects(manifest, OB.read_objects(spark, folder, "*.html"))
    return checked.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.when(F.col("state") == "ok", F.col("found_size"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state").isin("size_differs", "digest_differs")).alias("damaged"))


@register("artifact_states", f"SELECT deal_id, page_id, size, state FROM ({_OBJECTS}) WHERE state <> 'ok'")
def q_artifact_states(spark, sf_dir):
    """S3: the artifacts that cannot be used, and why."""
    manifest, folder = _objects(spark, sf_dir)
    bad = OB.check_objects(manifest, OB.read_objects(spark, folder, "*.html")).where("state <> 'ok'")
    return bad.select("deal_id", F.regexp_extract("rel_path", r"p (\d+)\.html$", 1).cast("bigint").alias("page_id"), "size", "state")


@register("sheet_scan", """
SELECT 's' || page_id AS key, octet_length(encode(html)) AS size FROM pages WHERE page_id % 10 = 3 AND length(html) > 1""")
def q_sheet_scan(spark, sf_dir):
    return OB.sheet_scan(spark, _objects(spark, sf_dir)[1])


PART = 1000    # artifacts in a manifest document

_DOCS = """
SELECT a.deal_id, a.pos // 1000 AS part, (a.m.deal_no + a.pos // 1000) % 7 AS kind, a.pos AS doc_pos, a.content_sha256,
       row_number() OVER (PARTITION BY a.deal_id, a.pos // 1000 ORDER BY a.pos) - 1 AS pos,
       coalesce(nullif(a.blob_url, ''), nullif(a.url, '')) AS src,
       coalesce(nullif(a.filename, ''), nullif(a.path, ''), nullif(a.name, '')) AS rel,
       nullif(trim(a.m.as_of), '') AS as_of, a.m.context_domain_pack, a.m.domain_pack, a.m.deal_no
FROM (SELECT x.*, m FROM artifacts x JOIN manifests m USING (deal_id)) a"""


def _manifest_files(spark, sf_dir, earlier=False):
    """Manifest documents, a file each; some torn, some not an object. An
    earlier run's lack some artifacts, and some of them a scope."""
    d = Derived(spark, sf_dir)

    def write(path):
        a, m = d.artifacts(), d.manifests()
        a = a.where("pos % 130 <> 7") if earlier else a
        m = m.where("deal_no <> 19").withColumn("as_of", F.expr("CASE WHEN deal_no % 5 <> 0 THEN as_of END")) if earlier else m
        part = F.floor(F.col("pos") / PART).cast("bigint")
        docs = a.withColumn("part", part).groupBy("deal_id", "part").agg(F.array_sort(F.collect_list(F.struct(
            "pos", "content_sha256", "blob_url", "url", "filename", "path", "name"))).alias("artifacts")).join(m, "deal_id")
        doc = F.to_json(F.struct("deal_id", "part", F.struct("as_of", F.col("context_domain_pack").alias("domain_pack")).alias("context"),
                                 "domain_pack", F.transform("artifacts", lambda e: e.dropFields("pos")).alias("artifacts")))
        kind = F.lit(0) if earlier else (F.col("deal_no") + F.col("part")) % 7
        text = F.when(kind == 3, F.left(doc, F.length(doc) - 5)).when(kind == 5, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
        docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return MA.read_manifests(spark, _files(spark, sf_dir, "manifest_documents" + "_earlier" * earlier, write))


@register("manifest_documents", with_ctes(f"""
SELECT CASE WHEN ok THEN deal_id END AS deal_id, CASE WHEN ok THEN part END AS part, CASE WHEN ok THEN any_value(as_of) END AS as_of,
       CASE WHEN ok THEN any_value(context_domain_pack) END AS context_domain_pack, CASE WHEN ok THEN any_value(domain_pack) END AS domain_pack,
       CASE WHEN ok THEN count(*) ELSE 0 END AS n_artifacts, CASE kind WHEN 3 THEN 'unreadable' WHEN 5 THEN 'not_an_object' END AS broken
FROM (SELECT *, kind NOT IN (3, 5) AS ok FROM ({_DOCS})) GROUP BY deal_id, part, kind, ok""", "artifacts", "manifests"))
def q_manifest_documents(spark, sf_dir):
    return _manifest_files(spark, sf_dir).select("deal_id", "part", "as_of", "context_domain_pack", "domain_pack",
                                                 F.size("artifacts").cast("bigint").alias("n_artifacts"), "broken")


@register("manifest_artifacts", with_ctes(f"""
SELECT deal_id, part, pos, src AS source_url, ltrim(ltrim(rel, '/'), '\\') AS rel_path, content_sha256
FROM ({_DOCS}) WHERE kind NOT IN (3, 5) AND src IS NOT NULL AND rel IS NOT NULL""", "artifacts", "manifests"))
def q_manifest_artifacts(spark, sf_dir):
    return MA.manifest_artifacts(_manifest_files(spark, sf_dir))


@register("manifest_keys", with_ctes(f"""
SELECT n.deal_id, n.part, n.key AS artifact_key, o.key IS NOT NULL AS has_record, n.deal_no % 6 = 0 AS force,
       CASE WHEN n.deal_no % 6 <> 0 AND coalesce(o.key = n.key AND o.as_of IS NOT DISTINCT FROM n.as_of, false)
            THEN 'skip_unchanged' ELSE 'compile' END AS decision, decision AS digest_decision
FROM (SELECT deal_id, part, kind, deal_no, as_of, sha256(array_to_string(list_sort(list(coalesce(content_sha256, ''))), chr(10))) AS key
      FROM ({_DOCS}) GROUP BY ALL) n
LEFT JOIN (SELECT deal_id, part, CASE WHEN deal_no % 5 <> 0 THEN as_of END AS as_of,
                  sha256(array_to_string(list_sort(list(coalesce(content_sha256, ''))), chr(10))) AS key
           FROM ({_DOCS}) WHERE doc_pos % 130 <> 7 AND deal_no <> 19 GROUP BY deal_id, part, deal_no, as_of) o
  ON n.deal_id = o.deal_id AND n.part = o.part
WHERE n.kind NOT IN (3, 5)""", "artifacts", "manifests"))
def q_manifest_keys(spark, sf_dir):
    """A1 and J1 over documents: the exact key, and the digest's decision beside it."""
    forced = F.substring("deal_id", 4, 10).cast("int") % 6 == 0
    return MA.manifest_decisions(_manifest_files(spark, sf_dir), _manifest_files(spark, sf_dir, earlier=True), forced)


@register("run_index_days", with_ctes(r"""
SELECT run_date, count(*) AS entries, count(*) FILTER (WHERE status = 'failed') AS failed
FROM (SELECT left(strftime(updated_at, '%Y-%m-%d'), 10) AS run_date, compile_id, status FROM status_events
      WHERE status IN ('completed', 'failed', 'interrupted')
      QUALIFY row_number() OVER (PARTITION BY left(strftime(updated_at, '%Y-%m-%d'), 10), compile_id
                                 ORDER BY updated_at DESC, seq DESC) = 1)
GROUP BY run_date""", "status_events"))
def q_run_index_days(spark, sf_dir):
    """S5 round trip: the index written partitioned by day and listed per
    day from the folders (a one-day reader prunes to its folder)."""
    def write(path):
        FS.write_partitioned(run_index(Derived(spark, sf_dir).status_events()), path, "run_date")
    path = _files(spark, sf_dir, "run_index", write)
    days = spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))
    return days.groupBy("run_date").agg(F.count(F.lit(1)).alias("entries"),
                                        F.count_if(F.col("status") == "failed").alias("failed"))


@register("status_sink", with_ctes(r"""
SELECT strftime(updated_at, '%Y-%m-%d') AS day, status, count(*) AS rows
FROM status_events
GROUP BY 1, 2""", "status_events"))
def q_status_sink(spark, sf_dir):
    """S4 round trip: status rows appended partitioned by day and read
    back whole (a reader of one day prunes to its folder)."""
    path = _files(spark, sf_dir, "status_events",
                  lambda p: FS.write_status_events(Derived(spark, sf_dir).status_events(), p))
    rows = spark.read.parquet(path)
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "status").agg(
        F.count(F.lit(1)).alias("rows"))


def _atom_sinks(spark, sf_dir) -> str:
    """The three sinks of a compile's atoms, below one folder."""
    from runlens.plans.q_atoms import ui
    return _files(spark, sf_dir, "atom_sinks",
                  lambda p: FS.write_atoms(ui(spark, sf_dir), Derived(spark, sf_dir).stage_timings(), p))


@register("atoms_open_maps", with_ctes("SELECT id, place, key, value FROM atoms_open", "atoms_open"))
def q_atoms_open_maps(spark, sf_dir):
    """Every key of the stored value and locator, known or not."""
    from runlens.operators.atoms import open_entries
    return open_entries(FS.read_atoms(spark, _atom_sinks(spark, sf_dir))["atoms"])


@register("atom_counts_sink", with_ctes("""
SELECT deal_id, CASE WHEN source_filename <> '' THEN source_filename ELSE '(unknown)' END AS file, atom_type, count(*) AS atoms
FROM atoms_ui GROUP BY ALL""", "atoms_ui"))
def q_atom_counts_sink(spark, sf_dir):
    """The counts sink (per deal, file and type)."""
    return FS.read_atoms(spark, _atom_sinks(spark, sf_dir))["counts"].select("deal_id", "file", "atom_type", "atoms")


@register("stage_timings_sink", with_ctes("""
SELECT compile_id, stage_no, stage_name, round(duration_ms, 3) AS duration_ms, warning_count, error_count FROM stage_timings""", "stage_timings"))
def q_stage_timings_sink(spark, sf_dir):
    """The stage sink."""
    return FS.read_atoms(spark, _atom_sinks(spark, sf_dir))["stages"].select(
        "compile_id", "stage_no", "stage_name", F.round("duration_ms", 3).alias("duration_ms"), "warning_count", "error_count")


@register("atoms_sink", with_ctes(r"""
SELECT deal_id, atom_type, count(*) AS atoms, count(*) FILTER (WHERE verified) AS verified
FROM atoms_ui GROUP BY 1, 2""", "atoms_ui"))
def q_atoms_sink(spark, sf_dir):
    """S6 round trip: UI atoms written by hash bucket of the deal (dynamic
    overwrite) and read back whole."""
    a = FS.read_atoms(spark, _atom_sinks(spark, sf_dir))["atoms"]
    return a.groupBy("deal_id", "atom_type").agg(F.count(F.lit(1)).alias("atoms"),
                                                 F.count_if("verified").alias("verified"))


_RUNS = """
SELECT compile_id, any_value(deal_id) AS deal_id, min(worker_sha) AS worker_sha, min(parser_sha) AS parser_sha, min(updated_at) AS started_at,
       max(updated_at) AS finished_at, max(entity_count) AS entity_count, max(atom_count) AS atom_count FROM status_events GROUP BY compile_id"""


def _traces(spark, sf_dir):
    """The stored trace documents of all runs, parsed. A run's stages are its
    status writes in order."""
    d = Derived(spark, sf_dir)

    def write(p):
        ev = d.status_events()
        runs = ev.groupBy("compile_id").agg(
            F.min("deal_id").alias("deal_id"), F.min("worker_sha").alias("worker_sha"), F.min("parser_sha").alias("parser_sha"),
            F.min("updated_at").alias("started_at"), F.max("updated_at").alias("finished_at"), F.max("entity_count").alias("entity_count"),
            F.max("atom_count").alias("atom_count"))
        timings = ev.select("compile_id", F.col("seq").alias("stage_no"), F.col("stage").alias("stage_name"), F.col("elapsed_sec").alias("duration_ms"),
                            F.col("atom_count").alias("input_count"), F.col("entity_count").alias("output_count"),
                            (F.col("seq") % 3).alias("warning_count"), F.lit(0).cast("bigint").alias("error_count"))
        DO.trace_documents(runs, timings, d.llm_calls()).write.mode("overwrite").json(p, compression="gzip")
    t = spark.read.schema("compile_id string, trace string").json(_files(spark, sf_dir, "traces", write))
    return t.select("compile_id", F.try_parse_json("trace").alias("doc"))


@register("trace_sink", with_ctes(f"""
SELECT r.compile_id, r.deal_id, r.worker_sha, r.parser_sha AS parser_os_sha, CAST(r.entity_count AS BIGINT) AS entity_count,
       CAST(r.atom_count AS BIGINT) AS atom_count, round((epoch_us(r.finished_at) - epoch_us(r.started_at)) / 1e6, 3) AS wall_clock_sec,
       s.stages, coalesce(c.calls, 0) AS total_calls, round(coalesce(c.latency, 0), 3) AS total_latency_sec,
       coalesce(c.multi, 0) AS multi_calls, coalesce(c.m0, 0) AS m0_calls, coalesce(c.longest, 0) AS longest_prompt
FROM ({_RUNS}) r JOIN (SELECT compile_id, count(*) AS stages FROM status_events GROUP BY 1) s USING (compile_id)
LEFT JOIN (SELECT compile_id, count(*) AS calls, sum(latency_sec) AS latency, count(*) FILTER (WHERE source = 'multi') AS multi,
                  count(*) FILTER (WHERE model = 'm0') AS m0, CAST(max(prompt_size) AS BIGINT) AS longest FROM llm_calls GROUP BY 1) c USING (compile_id)""",
    "status_events", "llm_calls"))
def q_trace_sink(spark, sf_dir):
    """S9 round trip: whole trace documents written, read back and asked for
    their fields, lists and counters."""
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    sizes = F.transform(get("$.llm_calls", "array<variant>"), lambda c: F.try_variant_get(c, "$.prompt_size", "bigint"))
    zero = F.lit(0).cast("bigint")
    return _traces(spark, sf_dir).select(
        "compile_id", *[get(f"$.{c}", "string").alias(c) for c in ("deal_id", "worker_sha", "parser_os_sha")],
        *[get(f"$.{c}", "bigint").alias(c) for c in ("entity_count", "atom_count")], get("$.wall_clock_sec", "double").alias("wall_clock_sec"),
        F.size(get("$.parser_trace.stages", "array<variant>")).cast("bigint").alias("stages"),
        get("$.llm_call_summary.total_calls", "bigint").alias("total_calls"),
        F.round(get("$.llm_call_summary.total_latency_sec", "double"), 3).alias("total_latency_sec"),
        F.coalesce(get("$.llm_call_summary.by_source.multi", "bigint"), zero).alias("multi_calls"),
        F.coalesce(get("$.llm_call_summary.by_model.m0", "bigint"), zero).alias("m0_calls"),
        F.coalesce(F.array_max(sizes), zero).alias("longest_prompt"))


@register("trace_stages", with_ctes("""
SELECT compile_id, row_number() OVER (PARTITION BY compile_id ORDER BY seq) AS pos, stage, round(elapsed_sec, 3) AS duration_ms,
       CAST(atom_count AS BIGINT) AS input, CAST(entity_count AS BIGINT) AS output, CAST(seq % 3 AS BIGINT) AS warning_count,
       CAST(0 AS BIGINT) AS error_count FROM status_events""", "status_events"))
def q_trace_stages(spark, sf_dir):
    """The stage list of the stored documents as a timeline."""
    rows = DO.stage_rows(_traces(spark, sf_dir))
    return rows.select("compile_id", "pos", "stage", F.round("duration_ms", 3).alias("duration_ms"), F.col("counts")["input"].alias("input"),
                       F.col("counts")["output"].alias("output"), "warning_count", "error_count")


@register("progress_documents", with_ctes("""
SELECT compile_id, deal_id, status, CASE WHEN status <> 'starting' THEN stage END AS current_stage,
       CASE WHEN status = 'running' AND stage <> 'projection' THEN phase END AS stage_phase, CASE WHEN status = 'starting' THEN 0 ELSE n END AS stage_count_done,
       CAST(CASE WHEN status = 'done' THEN n WHEN stage = 'projection' THEN CASE WHEN n > 0 THEN n + 1 ELSE 15 END ELSE 14 END AS BIGINT)
         AS stage_count_total_estimate,
       CAST(CASE WHEN status = 'starting' THEN 0 ELSE (epoch_us(updated_at) - epoch_us(started_at)) // 1000 END AS BIGINT) AS elapsed_ms
FROM (SELECT *, min(updated_at) OVER (PARTITION BY compile_id) AS started_at, CAST(seq % 4 AS BIGINT) AS n,
             CASE WHEN seq % 2 = 0 THEN 'start' ELSE 'end' END AS phase,
             CASE WHEN event_type = 'purchase' THEN 'done' WHEN seq % 7 = 0 THEN 'starting' ELSE 'running' END AS status,
             CASE WHEN seq % 5 = 0 THEN 'projection' ELSE raw_stage END AS stage
      FROM (SELECT * EXCLUDE (status, stage), stage AS raw_stage FROM status_events))""", "status_events"))
def q_progress_documents(spark, sf_dir):
    """Start estimate, projection, done; phase only of a running stage."""
    d = Derived(spark, sf_dir)
    ev, seq = d.status_events(), F.col("seq")
    first = ev.groupBy("compile_id").agg(F.min("updated_at").alias("started_at"))
    docs = ev.join(first, "compile_id").select(
        "compile_id", "deal_id", F.when(F.col("status") == "completed", "done").when(seq % 7 == 0, "starting").otherwise("running").alias("status"),
        F.when(seq % 5 == 0, DO.PROJECTION).otherwise(F.col("stage")).alias("current_stage"), F.when(seq % 2 == 0, "start").otherwise("end").alias("stage_phase"),
        F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), 1, (seq % 4).cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string"))).alias("stages"),
        "started_at", "updated_at", F.lit(None).cast("bigint").alias("stage_items_done"), F.lit(None).cast("bigint").alias("stage_items_total"))
    return DO.progress_documents(docs).select("compile_id", "deal_id", "status", "current_stage", "stage_phase", "stage_count_done",
                                              "stage_count_total_estimate", "elapsed_ms")


@register("envelope_sink", with_ctes(r"""
SELECT deal_id, CASE WHEN CAST(substr(deal_id, 4) AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END AS version,
       CASE WHEN CAST(substr(deal_id, 4) AS INTEGER) % 2 = 0 THEN 'run-2' ELSE 'run-1' END AS compile_id, count(*) AS atoms,
       CASE WHEN CAST(substr(deal_id, 4) AS INTEGER) % 2 = 0 THEN count(*) FILTER (WHERE verified)
            ELSE 0 END AS verified_atoms
FROM atoms_ui GROUP BY deal_id""", "atoms_ui"))
def q_envelope_sink(spark, sf_dir):
    """S7 round trip: version 1 of every deal's envelope (counts only), then
    version 2 for the even deals (with verified counts) upserted on top; each
    stamped with the run that wrote it."""
    from runlens.operators.atoms import envelope_rollup
    from runlens.plans.q_atoms import ui

    def write(path):
        roll = envelope_rollup(ui(spark, sf_dir))
        v1 = roll.select("deal_id", F.lit(1).alias("version"), "atoms",
                         F.lit(0).cast("bigint").alias("verified_atoms"))
        VE.upsert_by_key(spark, path, v1, compile_id=F.lit("run-1"))
        even = F.substring("deal_id", 4, 10).cast("int") % 2 == 0
        v2 = roll.where(even).select("deal_id", F.lit(2).alias("version"), "atoms",
                                     "verified_atoms")
        VE.upsert_by_key(spark, path, v2, compile_id=F.lit("run-2"))
    path = _files(spark, sf_dir, "envelopes", write)
    return VE.read_versioned(spark, path).select("deal_id", "version", "compile_id", "atoms", "verified_atoms")
