"""Tolerant message decoding, job projection, requester, routing.

All rules are Spark built-ins over ``VARIANT`` (``try_parse_json``), so a
malformed message yields nulls and a reason instead of failing the task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import col_, py_lstrip, py_strip

B64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="


def vtype(v: Column) -> Column:
    """Type name of a variant value ('OBJECT<...>', 'STRING', 'VOID', ...)."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def _utf8_or_null(b: Column) -> Column:
    return F.try_validate_utf8(b.cast("string"))


def base64_chars(text: Column) -> Column:
    """``text`` without the characters foreign to base64. Most texts have none,
    and a look tells so. Deleting the base64 characters names the foreign ones;
    a regular expression that replaces takes many times as long."""
    foreign = F.translate(text, B64_CHARS, "")
    return (F.when(text.rlike("^[A-Za-z0-9+/=]*+\\z"), text)
             .otherwise(F.call_function("translate", text, foreign, F.lit(""))))


def lenient_base64_text(clean: Column) -> Column:
    """Base64 -> UTF-8 text the lenient way, of a text whose foreign characters
    are dropped (``base64_chars``): its length must be a multiple of 4, invalid
    UTF-8 is null."""
    return F.when(F.length(clean) % 4 == 0, _utf8_or_null(F.unbase64(clean)))


def decode_stage(df, raw: str = "content", out: str = "_v", peek: str = "_peek"):
    """P1 (and the routing peek) in staged projections. Each message is
    parsed at most twice: directly, and through base64 only when the direct
    parse is not an object. The peek reuses those parses: a text starting
    with '{' peeks at the direct parse, any other text at the base64 parse
    when it is strict base64."""
    # Each text is stripped once: trimming looks at every character. Only a text
    # that begins with '{' can be an object, and is one if it parses: others are
    # not tried, as a parse that fails costs many that do not.
    s1 = df.select("*", py_strip(F.coalesce(F.col(raw), F.lit(""))).alias("_t"))
    t, b64t = F.col("_t"), F.col("_b64t")
    s1 = s1.select("*", F.when(t.startswith("{"), F.try_parse_json(t)).alias("_direct"))
    s2 = s1.select("*", F.col("_direct").isNotNull().alias("_d_ok"))
    s2 = s2.select("*", F.when(~F.col("_d_ok"), base64_chars(t)).alias("_clean"))
    s3 = s2.select("*", lenient_base64_text(F.col("_clean")).alias("_b64t"))
    s4 = s3.select("*", F.when(py_lstrip(b64t).startswith("{"), F.try_parse_json(b64t)).alias("_b64"))
    s5 = s4.select("*", F.col("_b64").isNotNull().alias("_b_ok"))
    strict = t.rlike("^[A-Za-z0-9+/]*+={0,2}\\z") & (F.length(t) % 4 == 0)
    peek_v = (F.when(t.startswith("{"), F.when(F.col("_d_ok"), F.col("_direct")))
               .when(F.col("_b_ok") & strict, F.col("_b64")))
    return s5.select(
        *df.columns,
        F.when(F.col("_d_ok"), F.col("_direct")).when(F.col("_b_ok"), F.col("_b64")).alias(out),
        peek_v.alias(peek))


def vget(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


# Paths of a job message that the rules read; each is extracted and typed
# once (``x_<name>`` / ``t_<name>``), then the rules below work on those
# plain columns so no expression re-parses the document.
JOB_PATHS = {
    "compile_id": "$.compile_id", "deal_id": "$.deal_id",
    "manifest_blob_url": "$.manifest_blob_url", "domain_pack": "$.domain_pack",
    "force": "$.force", "compile_options": "$.compile_options",
    "opt_force": "$.compile_options.force", "triggered_by": "$.triggered_by",
    "triggeredBy": "$.triggeredBy", "trigger": "$.trigger", "trigger_by": "$.trigger.by",
    "trigger_kind": "$.trigger.kind", "kind": "$.kind",
    "allow_errors": "$.compile_options.allow_errors",
    "abstain": "$.compile_options.abstain_threshold",
    "allow_unverified": "$.compile_options.allow_unverified_receipts",
    "use_cache": "$.compile_options.use_cache",
}


UNTYPED_PATHS = ("domain_pack", "kind", "allow_errors", "allow_unverified", "use_cache", "abstain")


def with_fields(df, vcol: str, paths: dict[str, str]):
    """Add ``x_<n>`` (the value as VARIANT, null when missing) and
    ``t_<n>`` (its type name) for every path whose type a rule reads, in
    two narrow projections."""
    df = df.select("*", *[F.try_variant_get(F.col(vcol), p, "variant").alias(f"x_{n}")
                          for n, p in paths.items()])
    return df.select("*", *[F.schema_of_variant(F.col(f"x_{n}")).alias(f"t_{n}")
                            for n in paths if n not in UNTYPED_PATHS])


def f_present(n: str) -> Column:
    return F.col(f"x_{n}").isNotNull()


def f_object(n: str) -> Column:
    return F.coalesce(F.col(f"t_{n}").startswith("OBJECT"), F.lit(False))


def f_truthy(n: str) -> Column:
    """Python truthiness of a JSON value (missing/null/false/0/''/[]/{} are
    false)."""
    x, t = F.col(f"x_{n}"), F.col(f"t_{n}")
    return (F.when(x.isNull(), F.lit(False))
             .when(t == "VOID", F.lit(False))
             .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
             .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
             .when(t.startswith("ARRAY"), F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
             .when(t.startswith("OBJECT"), t != "OBJECT<>")
             .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True))))


def f_str(n: str) -> Column:
    """``str(d[key])`` for a present key: JSON null becomes 'None'."""
    x, t = F.col(f"x_{n}"), F.col(f"t_{n}")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(t == "VOID", F.lit("None"))
             .when(t == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), "True")
                   .otherwise("False"))
             .otherwise(F.try_variant_get(x, "$", "string")))


def f_truthy_text(n: str) -> Column:
    """``str(d.get(key) or '')``: the text of a truthy value, else ''."""
    return F.when(f_truthy(n), f_str(n)).otherwise(F.lit(""))


def job_columns(df, vcol: str = "_v"):
    """P2 + P3: the job projection of a decoded message object.

    A missing required key, or a truthy non-object ``trigger`` or
    ``compile_options``, is a decode error (``job_ok`` false). The
    requester is the first truthy flat field (trimmed), else trigger.by,
    else trigger.kind; blanks are null.
    """
    df = with_fields(df, vcol, JOB_PATHS)
    step = df.select(
        "*",
        py_strip(F.when(f_truthy("triggered_by"), f_str("triggered_by"))
                .when(f_truthy("triggeredBy"), f_str("triggeredBy"))
                .otherwise(F.lit(""))).alias("_flat"),
        py_strip(f_truthy_text("trigger_by")).alias("_by"),
        py_strip(f_truthy_text("trigger_kind")).alias("_kind"),
        (f_truthy("compile_options") & ~f_object("compile_options")).alias("_opts_bad"),
        (f_truthy("trigger") & ~f_object("trigger")).alias("_trig_bad"),
        (f_truthy("force") | (f_object("compile_options") & f_truthy("opt_force"))).alias("_force"))
    ok = (F.col(vcol).isNotNull() & f_present("compile_id") & f_present("deal_id")
          & f_present("manifest_blob_url") & ~F.col("_opts_bad") & ~F.col("_trig_bad"))
    trig_obj = f_object("trigger")
    return step.select(
        "*",
        F.coalesce(ok, F.lit(False)).alias("job_ok"),
        f_str("compile_id").alias("compile_id"),
        f_str("deal_id").alias("deal_id"),
        f_str("manifest_blob_url").alias("manifest_blob_url"),
        F.try_variant_get(F.col("x_domain_pack"), "$", "string").alias("domain_pack"),
        F.col("_force").alias("force"),
        F.when(F.col("_flat") != "", F.col("_flat"))
         .when(trig_obj & (F.col("_by") != ""), F.col("_by"))
         .when(trig_obj & (F.col("_kind") != ""), F.col("_kind")).alias("triggered_by"),
        F.when(trig_obj & (F.col("_kind") != ""), F.col("_kind")).alias("trigger_kind"),
        F.try_variant_get(F.col("x_kind"), "$", "string").alias("kind"))


def blob_container(url) -> Column:
    """P5: first path segment of an object URL, percent-decoded ('+' kept)."""
    path = F.ltrim(F.regexp_extract(col_(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
                   F.lit("/"))
    return _unquote(F.when(F.locate("/", path) > 0, F.substring_index(path, "/", 1)))


def blob_path(url) -> Column:
    """P5: the rest of the path after the container, percent-decoded."""
    path = F.ltrim(F.regexp_extract(col_(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
                   F.lit("/"))
    pos = F.locate("/", path)
    return _unquote(F.when(pos > 0, F.substr(path, pos + 1)))


def _unquote(c: Column) -> Column:
    """``urllib.parse.unquote``: '+' stays '+', a '%' that begins no escape
    stays as it is, the good escapes around it are decoded."""
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), c)
