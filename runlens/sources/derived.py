"""Job-domain tables derived from the driver's Parquet tables.

The rules are modular arithmetic over the driver keys (see FIXTURES.md part
B) so the same table can be produced at any scale factor and re-derived by
DuckDB for the oracle. Every frame is lazy; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import dealt, materialized
from runlens.sources.tables import read_table

# Fixed values of the synthetic job domain (names are ours).
STAGE_NAMES = ["parse_artifacts", "classify", "extract_entities", "link_entities",
               "source_replay", "score", "project"]
LISTING_DIRS = ["_head_registry", "_calibrator", "_type_head", "_span_heads"]
GIB = 1073741824
MEMORY_UNIT = 16777216  # 2**24 bytes per unit of events.value


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _q(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def no_base64_breaks(c: Column) -> Column:
    """Spark may chunk base64 text with CRLF every 76 chars; drop those."""
    return F.translate(c, "\r\n", "")


class Derived:
    """Lazy accessors for the derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---------------------------------------------------------------- S1
    def raw_messages(self, parts: int | None = None) -> DataFrame:
        """``parts``: dealt to so many tasks (or more, ``dealt``) before the messages are
        built, for steps that work on each of them; a file of few row groups is read by few."""
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        o = dealt(o, parts) if parts else o
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (k % 30).cast("int")),
                            "yyyyMMdd")
        compile_id = F.concat(_s(F.floor(cust / 10)), F.lit("-"), day)
        deal = F.concat(F.lit("src"), _s(cust % 20))
        url = F.concat(F.lit("https://acct.example/box/deal%20"), _s(cust % 20),
                       F.lit("/m+"), _s(k), F.lit(".json"))
        r = k % 6
        parts = [
            F.when(k % 29 != 0, F.concat(F.lit('"compile_id": '), _q(compile_id))),
            F.concat(F.lit('"deal_id": '), _q(deal)),
            F.concat(F.lit('"manifest_blob_url": '), _q(url)),
            F.when(k % 4 == 0, F.concat(F.lit('"domain_pack": "dp'), _s(k % 3), F.lit('"')))
             .when(k % 4 == 1, F.lit('"domain_pack": ""')),
            F.when(k % 13 == 0, F.concat(F.lit('"compile_options": {"force": "false", "abstain_threshold": 0.'), _s(k % 5), F.lit("}"))),
            F.when(k % 11 == 0, F.lit('"force": true')),
            F.when(k % 23 == 0, F.lit('"kind": "sow_draft"')),
            F.when(r == 0, F.concat(F.lit('"triggered_by": "u'), _s(k % 7), F.lit('"')))
             .when(r == 1, F.concat(F.lit('"triggeredBy": "U'), _s(k % 5), F.lit('"')))
             .when(r == 2, F.concat(F.lit('"trigger": {"kind": "manual", "by": "p'),
                                    _s(k % 3), F.lit('"}')))
             .when(r == 3, F.lit('"trigger": {"kind": "timer"}'))
             .when(r == 4, F.lit('"triggered_by": "   ", "trigger": {"kind": " ", "by": ""}')),
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
        text = F.when(k % 3 == 1, no_base64_breaks(F.base64(F.encode(body, "UTF-8")))).otherwise(body)
        content = F.when(k % 17 == 0, F.left(text, F.lit(10))).otherwise(text)
        return o.select(
            k.alias("message_id"),
            F.when(F.col("o_orderpriority") < "3", "priority").otherwise("normal").alias("lane"),
            F.col("o_orderdate").cast("timestamp").alias("received_at"),
            (F.lit(1) + k % 5).cast("int").alias("dequeue_count"),
            content.alias("content"))

    # ---------------------------------------------------------- manifests
    def artifacts(self) -> DataFrame:
        """Raw manifest entries, one row per (deal, artifact)."""
        d = F.col("doc_id")
        ds = _s(d)
        return self.t("documents").select(
            F.col("source").alias("deal_id"),
            d.alias("pos"),
            F.when(d % 97 == 0, F.lit(None).cast("string"))
             .otherwise(F.sha2(F.col("text"), 256)).alias("content_sha256"),
            F.when(d % 50 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("https://acct.example/box/"), F.col("source"),
                                 F.lit("/"), ds, F.lit(".txt"))).alias("blob_url"),
            F.when((d % 50 == 0) & (d % 100 != 0),
                   F.concat(F.lit("https://acct.example/alt%20box/"), ds, F.lit("+v.txt")))
             .alias("url"),
            F.when(d % 2 == 0, F.concat(F.lit("//docs/"), ds, F.lit(".txt"))).alias("filename"),
            F.when(d % 10 == 5, F.concat(F.lit("p/"), ds, F.lit(".txt"))).alias("path"),
            F.when(d % 2 == 1, F.concat(F.lit("\\"), ds, F.lit(".txt"))).alias("name"),
            F.col("n_chars").alias("size"))

    def manifests(self) -> DataFrame:
        """One manifest per deal; its artifacts are the rows of ``artifacts``."""
        deals = self.t("documents").groupBy(F.col("source").alias("deal_id")).agg(
            F.count(F.lit(1)).alias("n_artifacts"))
        n = F.substring(F.col("deal_id"), 4, 10).cast("int")
        return deals.select(
            "deal_id", n.alias("deal_no"), "n_artifacts",
            F.when(n % 3 == 0, F.lit(None).cast("string"))
             .when((n % 3 == 1) & (n % 2 == 0), F.lit("   "))
             .otherwise(F.concat(F.lit(" 2026-01-0"), _s(n % 9 + 1), F.lit(" "))).alias("as_of"),
            F.when(n % 4 == 0, F.concat(F.lit("ctx"), _s(n % 2)))
             .when(n % 4 == 1, F.lit("")).alias("context_domain_pack"),
            F.when(n % 5 == 0, F.concat(F.lit("m"), _s(n))).alias("domain_pack"))

    # ------------------------------------------------------------ status
    def _events(self, parts: int | None = None) -> DataFrame:
        e = self.t("events")
        e = dealt(e, parts) if parts else e
        ts = F.col("ts").cast("timestamp")
        return e.select(
            F.col("event_id"), ts.alias("ts"), F.col("user_id"), F.col("event_type"),
            F.col("value"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.concat(_s("user_id"), F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("compile_id"),
            F.concat(F.lit("d"), _s("user_id")).alias("deal_id"))

    @staticmethod
    def _stage_of(t: Column, e: Column) -> Column:
        return (F.when(t == "view", "parse").when(t == "click", "enrich")
                 .when(t == "purchase", "done")
                 .when(t == "signup", F.when(e % 2 == 1, "terminated").otherwise("cancelled"))
                 .otherwise(F.element_at(F.array(*[F.lit(s) for s in (
                     "timeout", "killed", "out_of_memory", "exception", "exhausted_retries")]),
                     (e % 5 + 1).cast("int"))))

    def status_events(self, parts: int | None = None) -> DataFrame:
        """``parts`` as for ``raw_messages``."""
        ev = self._events(parts)
        t, e = F.col("event_type"), F.col("event_id")
        status = (F.when(t.isin("view", "click"), "running").when(t == "purchase", "completed")
                   .when(t == "signup", F.when(e % 2 == 1, "interrupted").otherwise("cancelled"))
                   .otherwise("failed"))
        return ev.select(
            "compile_id", "deal_id", status.alias("status"),
            self._stage_of(t, e).alias("stage"),
            F.col("ts").alias("updated_at"), e.alias("seq"),
            F.col("value").alias("elapsed_sec"),
            F.col("k").alias("atom_count"),
            F.floor(F.col("k") / 3).cast("bigint").alias("entity_count"),
            F.when(t == "purchase", F.lit(100)).otherwise(F.col("k")).cast("int")
             .alias("percent_complete"),
            F.when(t == "error", F.repeat(F.lit("E"), (F.lit(480) + e % 60).cast("int")))
             .alias("error"),
            F.when(t == "error", F.concat(F.lit("Traceback #"), _s(e))).alias("traceback"),
            F.concat(F.lit("w"), _s(F.col("user_id") % 3)).alias("worker_sha"),
            F.concat(F.lit("p"), _s(F.col("user_id") % 2)).alias("parser_sha"))

    def progress_events(self) -> DataFrame:
        """Written once per version of the data, like any table of records."""
        return materialized(self.spark, "progress_events", self.sf_dir, self._progress_events)

    def _progress_events(self) -> DataFrame:
        from runlens.operators.sequence import sequence_index

        ev = self._events()
        t, e = F.col("event_type"), F.col("event_id")
        base = ev.select(
            "compile_id", "deal_id",
            F.when(t == "purchase", "done").otherwise("running").alias("status"),
            self._stage_of(t, e).alias("current_stage"),
            F.col("ts").alias("updated_at"), e.alias("seq"), "k",
            F.concat(F.lit("r"), _s(F.col("user_id") % 4)).alias("replica"),
            F.concat(F.lit('["'), self._stage_of(t, e), F.lit('"]')).alias("stages"),
            F.date_format("ts", "yyyy-MM-dd").alias("started_at"),
            (F.col("k") % 12).cast("bigint").alias("stage_count_done"),
            F.lit(12).cast("bigint").alias("stage_count_total_estimate"),
            F.when(e % 5 != 0, F.concat(F.lit("pm"), _s(e % 4))).alias("triggered_by"),
            F.when(e % 2 == 0, F.lit("manual")).alias("trigger_kind"))
        idx = sequence_index(base, ["compile_id", "current_stage"], ["updated_at", "seq"],
                             sums=["k"])
        totals = base.groupBy("compile_id", "current_stage").agg(
            (F.count(F.lit(1)) * 100).cast("bigint").alias("stage_items_total"))
        return (idx.join(totals, ["compile_id", "current_stage"])
                   .withColumn("stage_items_done", F.col("run_k").cast("bigint"))
                   .drop("run_k", "seq_idx", "k"))

    def active_markers(self) -> DataFrame:
        """The first event of each run marks it active on its replica/boot."""
        ev = self._events()
        first = ev.groupBy("compile_id").agg(
            F.min(F.struct("ts", "event_id", "user_id", "deal_id", "event_type")).alias("f"))
        u = F.col("f.user_id")
        return first.select(
            "compile_id", F.col("f.deal_id").alias("deal_id"),
            F.when(u % 7 == 0, F.lit(None).cast("string"))
             .otherwise(self._stage_of(F.col("f.event_type"), F.col("f.event_id"))).alias("stage"),
            F.col("f.ts").alias("updated_at"),
            F.concat(F.lit("r"), _s(u % 4)).alias("replica"),
            F.concat(F.lit("b"), _s(F.floor(F.dayofmonth("f.ts") / 10))).alias("boot_id"))

    def replica_boots(self) -> DataFrame:
        ev = self._events()
        return ev.groupBy(
            F.concat(F.lit("r"), _s(F.col("user_id") % 4)).alias("replica"),
            F.concat(F.lit("b"), _s(F.floor(F.dayofmonth("ts") / 10))).alias("boot_id"),
        ).agg(F.min("ts").alias("booted_at"))

    def memory_samples(self) -> DataFrame:
        ev = self._events()
        return ev.select(
            "compile_id", "deal_id", F.col("ts").alias("sampled_at"),
            F.col("event_id").alias("seq"),
            F.floor(F.col("value") * MEMORY_UNIT).cast("bigint").alias("rss_bytes"),
            F.lit(200 * MEMORY_UNIT).cast("bigint").alias("limit_bytes"),
            F.lit(0.9).alias("fraction"))

    def cancel_requests(self) -> DataFrame:
        ev = self._events().where(F.col("event_type") == "signup")
        e = F.col("event_id")
        foreign = F.concat(_s(F.col("user_id") + 1), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
        prev_day = F.concat(_s("user_id"), F.lit("-"),
                            F.date_format(F.col("ts") - F.expr("INTERVAL 1 DAY"), "yyyyMMdd"))
        return ev.select(
            e.alias("request_id"), "deal_id",
            F.when(e % 15 == 0, F.lit(" \t")).when(e % 3 == 0, F.lit(None).cast("string"))
             .when(e % 15 == 1, F.concat(F.lit("\n "), "compile_id", F.lit("\u00a0")))
             .when(e % 15 == 4, foreign)
             .when(e % 3 == 1, F.col("compile_id")).otherwise(prev_day).alias("compile_id"),
            F.concat(F.lit("pm"), _s(e % 4)).alias("requested_by"),
            F.col("ts").alias("requested_at"))

    def errors(self) -> DataFrame:
        ev = self._events().where(F.col("event_type") == "error")
        e = F.col("event_id")
        return ev.select(
            e.alias("error_id"), "compile_id", "deal_id", F.col("ts").alias("failed_at"),
            F.element_at(F.array(*[F.lit(x) for x in (
                "ResourceNotFoundError", "HttpResponseError", "NotFoundError",
                "TimeoutError", "ValueError")]), (e % 5 + 1).cast("int")).alias("error_type"),
            F.element_at(F.array(*[F.lit(x) for x in (
                "ResourceNotFoundError: BlobNotFound",
                "HttpResponseError: The specified blob does not exist.",
                "NotFoundError: blob gone",
                "TimeoutError: t",
                "ValueError: notfound")]), (e % 5 + 1).cast("int")).alias("error"),
            F.repeat(F.lit("T"), (F.lit(3990) + e % 20).cast("int")).alias("traceback"))

    def llm_calls(self) -> DataFrame:
        ev = self._events().where(F.col("event_type").isin("view", "click"))
        e = F.col("event_id")
        return ev.select(
            e.alias("call_id"), "compile_id", "ts",
            F.when(F.col("event_type") == "view", "multi").otherwise("verify").alias("source"),
            F.col("k").alias("prompt_size"),
            (F.lit(512) * (e % 4 + 1)).cast("bigint").alias("max_tokens"),
            (F.col("k") * 10 + e % 7).cast("bigint").alias("response_size"),
            F.col("value").alias("latency_sec"),
            F.concat(F.lit("m"), _s(F.col("user_id") % 2)).alias("model"))

    def attempts(self) -> DataFrame:
        """Deliveries of one message: the runs of one user in time order."""
        ev = self._events()
        return ev.select(
            F.concat(F.lit("msg"), _s("user_id")).alias("message_key"),
            "compile_id", F.col("event_id").alias("seq"),
            F.col("ts").alias("received_at"),
            F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000)
                               .cast("bigint")).alias("ended_at"))

    # ------------------------------------------------------------ traces
    def stage_timings(self) -> DataFrame:
        li = self.t("lineitem")
        names = F.array(*[F.lit(s) for s in STAGE_NAMES])
        return li.select(
            F.concat(F.lit("o"), _s("l_orderkey")).alias("compile_id"),
            F.element_at(names, F.col("l_linenumber")).alias("stage_name"),
            F.col("l_linenumber").alias("stage_no"),
            F.col("l_partkey"), F.col("l_suppkey"),
            F.col("l_extendedprice").alias("duration_ms"),
            F.col("l_quantity").cast("bigint").alias("input_count"),
            F.floor(F.col("l_quantity") * (F.lit(1) - F.col("l_discount"))).cast("bigint")
             .alias("output_count"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint")
             .alias("warning_count"),
            F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), 1)
             .otherwise(0).cast("bigint").alias("error_count"))


def stored_fingerprints(d: Derived) -> DataFrame:
    """Fingerprint records of the previous run: the artifacts of that run
    lacked pos % 130 = 7; legacy records (deal_no % 5 = 0) carry no as_of;
    deal 19 has never completed."""
    from runlens.operators.fingerprint import fingerprints

    prev = fingerprints(d.artifacts().where(F.col("pos") % 130 != 7))
    m = d.manifests()
    return (prev.join(m.select("deal_id", "deal_no", "as_of"), "deal_id")
              .where(F.col("deal_no") != 19)
              .select("deal_id", "artifact_key",
                      F.when(F.col("deal_no") % 5 == 0, F.lit(None).cast("string"))
                       .otherwise(F.col("as_of")).alias("as_of")))


ATOM_TYPES_BY_ROLE = {"system": "constraint", "user": "request", "assistant": "answer"}


def atoms_raw(d: Derived) -> DataFrame:
    """Extracted atoms in the extractor's nested shape: one per conversation
    turn, with open ``value``/``locator`` maps, source refs and receipts."""
    conv = d.t("conversations").alias("c").join(
        d.t("labels").alias("l"), F.col("c.conv_id") == F.col("l.doc_id"), "left")
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    said_by = F.when(c % 3 == 0, F.concat(F.lit("P"), _s(c), F.lit(" · Org")))
    speaker = F.when(t % 2 == 0, role)
    loc_speaker = F.when(t % 3 == 0, F.concat(F.lit("L"), role))
    has_refs = c % 7 != 0
    label = F.coalesce(said_by, speaker, F.when(has_refs, loc_speaker))
    prefix = F.when((t % 4 == 1) & label.isNotNull(), F.concat(label, F.lit(" — "))).otherwise("")
    text = F.concat(prefix, F.col("text"))

    def kv(*pairs):
        arr = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
                        for k, v in pairs])
        return F.map_from_entries(F.filter(arr, lambda e: e["value"].isNotNull()))

    locator = kv(("section_path", F.concat(F.lit("turn/"), _s(t))), ("speaker", loc_speaker),
                 ("voice", F.when(c % 12 == 1, F.lit("lv"))), ("page", t))
    value = kv(("text", F.when(t % 5 != 0, text)), ("said_by", said_by), ("speaker", speaker),
               ("party", F.when(t % 3 == 1, F.concat(F.lit("party"), _s(c % 2)))),
               ("speaker_role", F.when(c % 4 == 0, F.concat(F.lit("role"), _s(c % 3)))),
               ("affiliation", F.when(t % 4 == 2, F.concat(F.lit("aff"), _s(c % 5)))),
               ("voice", F.when(c % 6 == 1, F.concat(F.lit("v"), _s(t % 2)))),
               ("org_role", F.when((c + t) % 5 == 0, F.lit("o"))), ("mood", F.when(t % 7 == 3, F.lit("calm"))))
    ref = F.struct(
        F.when(c % 10 != 0, F.concat(F.lit("conv-"), _s(c % 20), F.lit(".txt"))).alias("filename"),
        F.when(c % 2 == 0, F.concat(F.lit("a"), _s(c))).alias("artifact_id"),
        F.lit("chat").alias("extraction_method"), locator.alias("locator"))
    receipt_t = "array<struct<kind:string,status:string>>"
    receipts = F.when(F.col("l.doc_id").isNotNull(), F.array(
        F.struct(_s("quality").alias("kind"),
                 F.when(F.col("quality") == 1, "Verified").otherwise("rejected").alias("status")),
        F.struct(F.lit("").alias("kind"),
                 F.when(F.col("toxic") == 0, "ok").otherwise("no").alias("status")),
    )).otherwise(F.lit(None).cast(receipt_t))
    return conv.select(
        (c * 1000 + t).alias("id"),
        F.concat(F.lit("src"), _s(c % 20)).alias("deal_id"),
        c.alias("conv_id"), t.alias("turn"), role.alias("role"),
        F.element_at(F.create_map(*[F.lit(x) for kvp in ATOM_TYPES_BY_ROLE.items() for x in kvp]),
                     role).alias("atom_type"),
        F.concat(F.lit("art-"), _s(c % 20)).alias("artifact_id"),
        ((t + 1) / 10.0).alias("confidence"),
        F.when(t % 2 == 0, (t + 1) / 20.0).alias("calibrated_confidence"),
        text.alias("raw_text"), F.lit(None).cast("string").alias("normalized_text"),
        value.alias("value"),
        F.array(F.concat(F.lit("conv:"), _s(c)), F.concat(F.lit("role:"), role)).alias("entity_keys"),
        F.when(has_refs, F.array(ref)).alias("source_refs"),
        receipts.alias("receipts"),
        F.when(role == "system", "policy").otherwise("party").alias("authority_class"),
        F.when(t % 3 == 0, "pending").otherwise("accepted").alias("review_status"),
        F.lit("v1").alias("parser_version"))


ML_BASE = "/tmp/ml"   # the artifact folder named in configuration paths
LOG_NAME = "_training_log.db"
CACHE_NAME = "_embed_cache.db"


def local_listing(d: Derived) -> DataFrame:
    """Files on the worker: registry-style files plus the log and cache."""
    doc = d.t("documents")
    dd = F.col("doc_id")
    files = doc.where(dd % 5 != 3).select(
        F.concat(F.element_at(F.array(*[F.lit(x) for x in LISTING_DIRS]), (dd % 4 + 1).cast("int")),
                 F.lit("/h_"), _s(dd), F.lit(".npz")).alias("name"),
        F.col("n_chars").alias("size"))
    extra = doc.agg(F.sum("n_chars").alias("a"), F.count(F.lit(1)).alias("b")).select(
        F.explode(F.array(F.struct(F.lit(LOG_NAME).alias("name"), F.col("a").alias("size")),
                          F.struct(F.lit(CACHE_NAME).alias("name"), F.col("b").alias("size"))))
        .alias("x")).select("x.name", "x.size")
    return files.unionByName(extra)


def remote_listing(d: Derived) -> DataFrame:
    doc = d.t("documents")
    dd = F.col("doc_id")
    return doc.where(dd % 10 != 4).select(
        F.concat(F.element_at(F.array(*[F.lit(x) for x in LISTING_DIRS]), (dd % 4 + 1).cast("int")),
                 F.lit("/h_"), _s(dd), F.lit(".npz")).alias("name"),
        (F.col("n_chars") + F.when(dd % 7 == 0, 1).otherwise(0)).alias("size"))


def fetch_names(d: Derived) -> DataFrame:
    """The artifact store's listing seen by the fetch."""
    p = F.col("p_partkey")
    ps = _s(p)
    name = (F.when(p % 8 == 0, F.concat(F.lit("dataset/"), ps, F.lit(".json")))
             .when(p % 8 == 1, F.concat(F.lit("a/"), ps, F.lit(".PNG")))
             .when(p % 8 == 2, F.concat(F.lit("_training_"), ps, F.lit(".db")))
             .when(p % 8 == 3, F.when(p == 3, F.lit(LOG_NAME))
                   .otherwise(F.concat(F.lit("x/_runpod_"), ps, F.lit(".bin"))))
             .when(p % 8 == 4, F.concat(F.lit("_head_registry/"), ps, F.lit(".npz")))
             .when(p % 8 == 5, F.concat(F.lit("x_backup_"), ps))
             .when(p % 8 == 6, F.concat(F.lit("heads/"), ps, F.lit(".pkl")))
             .otherwise(F.concat(F.lit("z/"), ps, F.lit(".zip"))))
    return d.t("part").select(name.alias("name"), F.col("p_size").cast("bigint").alias("size"))


def artifact_config(d: Derived) -> DataFrame:
    """Configured artifact paths (key -> absolute path)."""
    p = F.col("p_partkey")
    ps = _s(p)
    path = (F.when(p % 5 == 0, F.concat(F.lit(ML_BASE + "/heads/"), ps, F.lit(".pkl")))
             .when(p % 5 == 1, F.concat(F.lit(ML_BASE + "/heads/missing_"), ps, F.lit(".pkl")))
             .when(p % 5 == 2, F.concat(F.lit(ML_BASE + "/nosrc/"), ps, F.lit(".bin")))
             .when(p % 5 == 3, F.concat(F.lit(ML_BASE + "/cache/"), ps, F.lit(".db")))
             .otherwise(F.concat(F.lit("/var/other/"), ps)))
    return d.t("part").select(F.concat(F.lit("K"), ps).alias("key"), path.alias("path"))


def draft_tables(d: Derived) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests with the writer's draft, latest envelopes, handoffs), each
    keyed by deal; an envelope may lack its brief, a deal its handoff."""
    rows = draft_inputs(d)
    return (rows.select("request_id", "deal_id", "requested_by", "draft_doc"),
            rows.select("deal_id", F.col("envelope_compile_id").alias("compile_id"),
                        F.when(F.col("has_brief"), F.lit("brief")).alias("brief")),
            rows.where("has_handoff").select("deal_id", F.lit("handoff").alias("handoff")))


def draft_inputs(d: Derived) -> DataFrame:
    """Per customer: a draft request, the deal's latest envelope and the
    writer's draft (draft_doc) for it."""
    c = F.col("c_custkey")
    h = F.md5(_s(c))
    deal = F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
                       F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)),
                       F.substr(h, F.lit(21), F.lit(12)))
    deal = F.when(c % 13 == 0, F.concat(F.lit("z"), F.substr(deal, F.lit(2)))).otherwise(deal)
    st = c % 4
    call = "struct<call:string,tries:int>"
    failures = (F.when(c % 3 == 0, F.array(*[F.struct(F.lit(x).alias("call"), F.lit(1).alias("tries"))
                                             for x in ("scope", "assumptions", "scope")]))
                 .when(c % 3 == 1, F.array(F.struct(F.lit("pricing").alias("call"),
                                                    F.lit(2).alias("tries"))))
                 .otherwise(F.array().cast(f"array<{call}>")))
    sow = F.struct(
        F.when(st == 0, "ok").when(st == 1, "degraded").when(st == 2, "failed").alias("draft_status"),
        F.when((st == 2) & (c % 8 == 2), F.lit("no sites found")).alias("failed_because"),
        F.when((st == 2) & (c % 8 == 6), F.lit("boom")).alias("error"),
        F.when(st.isin(1, 2), failures).alias("llm_failures"),
        F.array_repeat(F.struct(F.lit("site").alias("site")), (c % 5).cast("int")).alias("locations"),
        F.when(c % 2 == 0, F.lit("crm")).alias("site_source"),
        F.concat(F.lit("fam"), _s(c % 3)).alias("job_family"),
        F.when(c % 6 != 0, F.lit("model")).alias("job_family_by"),
        F.when(c % 7 != 0, F.create_map(F.lit("template"), (c % 4).cast("bigint"), F.lit("deal"), (c % 9).cast("bigint")))
         .alias("origin_counts"))
    return d.t("customer").select(
        c.alias("request_id"), deal.alias("deal_id"),
        F.concat(F.col("c_name"), F.repeat(F.lit("x"), (c % 150).cast("int"))).alias("requested_by"),
        F.concat(F.lit("env-"), _s(c)).alias("envelope_compile_id"),
        (c % 9 != 0).alias("has_brief"), (c % 5 != 0).alias("has_handoff"),
        sow.alias("draft_doc"))


def sibling_listing(d: Derived) -> DataFrame:
    """Mail-style artifacts listed under a shared base name per deal."""
    dd = F.col("doc_id")
    return d.t("documents").select(
        F.col("source").alias("deal_id"), F.concat(F.lit("mail-"), _s(dd % 50)).alias("base"),
        F.concat(F.lit("mail-"), _s(dd % 50), F.lit("/"), _s(dd), F.lit(".eml")).alias("name"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_sha256"))
