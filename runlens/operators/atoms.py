"""P16-P19 atom flattening, U1 extraction hook, A2-A4 counts, U2/U3 hooks.

The flatten is one projection of Spark higher-order and map functions over
the nested atom row (``get``, ``exists``, ``filter``/``transform``,
``map_concat``/``map_filter``); no Python runs per atom.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import py_strip

# Fixed values of the reference's atom rules.
VERIFIED_STATUSES = ("verified", "ok", "supported")
LOCATOR_FILL_KEYS = ("affiliation", "party", "voice", "org_role")
UNKNOWN_FILE = "(unknown)"
LABEL_SEPARATOR = " — "


def _s(m: Column, key: str) -> Column:
    """``str(m.get(key) or '')`` for a string map."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def flatten_atoms(atoms: DataFrame) -> DataFrame:
    """P16 + P17 + P18 + P19: the UI shape of every atom."""
    primary = F.get(F.coalesce(F.col("source_refs"), F.array()), 0)
    empty = F.create_map().cast("map<string,string>")
    s1 = atoms.select(
        "*",
        F.coalesce(primary["locator"], empty).alias("_loc"),
        F.coalesce(primary["filename"], F.lit("")).alias("source_filename"),
        F.coalesce(primary["extraction_method"], F.lit("")).alias("extraction_method"),
        F.coalesce(F.nullif(primary["artifact_id"], F.lit("")),
                   F.nullif(F.col("artifact_id"), F.lit("")), F.lit("")).alias("source_artifact_id"),
        F.coalesce(F.col("value"), empty).alias("_val"),
        F.coalesce(F.col("receipts"), F.array()).alias("_rc"))
    s2 = s1.select(
        "*",
        py_strip(_s(F.col("_val"), "said_by")).alias("_said"),
        F.when(py_strip(_s(F.col("_val"), "speaker")) != "", py_strip(_s(F.col("_val"), "speaker")))
         .otherwise(py_strip(_s(F.col("_loc"), "speaker"))).alias("_spk"),
        F.exists("_rc", lambda r: F.lower(F.coalesce(r["status"], F.lit("")))
                 .isin(*VERIFIED_STATUSES)).alias("verified"),
        F.filter(F.transform("_rc", lambda r: F.coalesce(r["kind"], F.lit(""))),
                 lambda k: k != "").alias("_kinds"),
        F.when(py_strip(_s(F.col("_val"), "text")) != "", py_strip(_s(F.col("_val"), "text")))
         .otherwise(F.coalesce(F.col("raw_text"), F.lit(""))).alias("_body0"))
    label = F.when(F.col("_said") != "", F.col("_said")).otherwise(F.col("_spk"))
    s3 = s2.select("*", label.alias("_label"))
    lab = F.col("_label")
    body0 = F.col("_body0")
    prefixed = ((lab != "") & body0.startswith(lab)
                & (F.locate(LABEL_SEPARATOR, F.left(body0, F.length(lab) + 4)) > 0))
    rest = py_strip(F.substr(body0, F.locate(LABEL_SEPARATOR, body0) + len(LABEL_SEPARATOR)))
    body = F.when(prefixed & (rest != ""), rest).otherwise(body0)
    loc, val = F.col("_loc"), F.col("_val")

    def missing(m, k):
        return _s(m, k) == ""
    fills = F.array(
        F.struct(F.lit("section_path").alias("key"), lab.alias("value")),
        F.struct(F.lit("speaker").alias("key"),
                 F.when((F.col("_spk") != "") & missing(loc, "speaker"), F.col("_spk")).alias("value")),
        F.struct(F.lit("speaker_role").alias("key"),
                 F.when((_s(val, "speaker_role") != "") & missing(loc, "speaker_role"),
                        _s(val, "speaker_role")).alias("value")),
        *[F.struct(F.lit(k).alias("key"),
                   F.when((_s(val, k) != "") & missing(loc, k), _s(val, k)).alias("value"))
          for k in LOCATOR_FILL_KEYS])
    fill_map = F.map_from_entries(F.filter(fills, lambda e: e["value"].isNotNull()))
    filled = F.map_concat(F.map_filter(loc, lambda k, v: ~F.array_contains(F.map_keys(fill_map), k)),
                          fill_map)
    s4 = s3.select("*", body.alias("_body"),
                   F.when(lab != "", filled).otherwise(loc).alias("locator_out"))
    b = F.col("_body")
    # The maps as they are written: body, speaker and said_by filled in, every other key as it came.
    own = F.array(
        F.struct(F.lit("text").alias("key"), F.when(b != "", b).alias("value")),
        F.struct(F.lit("speaker").alias("key"), F.when((F.col("_spk") != "") & missing(val, "speaker"), F.col("_spk")).alias("value")),
        F.struct(F.lit("said_by").alias("key"), F.when((F.col("_said") != "") & missing(val, "said_by"), F.col("_said")).alias("value")))
    put = F.map_from_entries(F.filter(own, lambda e: e["value"].isNotNull()))
    value_out = F.map_concat(F.map_filter(val, lambda k, v: ~F.array_contains(F.map_keys(put), k)), put)
    s4 = s4.withColumn("value_out", value_out)
    return s4.select(
        "id", "deal_id", F.coalesce(F.col("atom_type"), F.lit("unknown")).alias("atom_type"),
        "confidence", "calibrated_confidence", "verified",
        F.array_join("_kinds", ",").alias("receipt_kinds"),
        F.coalesce("authority_class", F.lit("")).alias("authority_class"),
        F.coalesce("review_status", F.lit("")).alias("review_status"),
        b.alias("raw_text"),
        F.when(b != "", b).otherwise(F.coalesce("normalized_text", F.lit(""))).alias("normalized_text"),
        F.when(b != "", b).otherwise(F.try_element_at(val, F.lit("text"))).alias("value_text"),
        F.when((F.col("_spk") != "") & missing(val, "speaker"), F.col("_spk"))
         .otherwise(F.try_element_at(val, F.lit("speaker"))).alias("value_speaker"),
        F.when((F.col("_said") != "") & missing(val, "said_by"), F.col("_said"))
         .otherwise(F.try_element_at(val, F.lit("said_by"))).alias("value_said_by"),
        F.array_join(F.coalesce("entity_keys", F.array()), ",").alias("entity_keys"),
        F.when(lab != "", lab).otherwise(F.try_element_at(loc, F.lit("section_path")))
         .alias("section_path"),
        "source_artifact_id", "source_filename", "extraction_method",
        F.try_element_at("locator_out", F.lit("section_path")).alias("locator_section_path"),
        F.try_element_at("locator_out", F.lit("speaker")).alias("locator_speaker"),
        F.try_element_at("locator_out", F.lit("party")).alias("locator_party"),
        F.coalesce("parser_version", F.lit("")).alias("parser_version"),
        F.col("value_out").alias("value"), F.col("locator_out").alias("locator"))


def picked(ui: DataFrame) -> DataFrame:
    """The flat columns of the flattened atoms, without the open maps."""
    return ui.drop("value", "locator")


def open_entries(atoms: DataFrame) -> DataFrame:
    """(id, place, key, value): every key of the VARIANT columns ``value`` and
    ``locator`` of stored atoms, whatever keys they have."""
    out = None
    for place in ("value", "locator"):
        m = F.explode(F.try_variant_get(place, "$", "map<string,string>"))
        part = atoms.select("id", F.lit(place).alias("place"), m.alias("key", "value"))
        out = part if out is None else out.unionByName(part)
    return out


def atoms_by_type(ui: DataFrame) -> DataFrame:
    """A2: the atom-type counter."""
    return ui.groupBy("atom_type").agg(F.count(F.lit(1)).alias("atoms"))


def atoms_by_artifact(ui: DataFrame) -> DataFrame:
    """A3: per file total (atom_type null) and per file and type; a blank
    filename counts as '(unknown)'."""
    f = F.when(F.col("source_filename") != "", F.col("source_filename")).otherwise(UNKNOWN_FILE)
    return (ui.withColumn("file", f)
              .groupingSets([["file"], ["file", "atom_type"]], "file", "atom_type")
              .agg(F.count(F.lit(1)).alias("atoms")))


# Line-length buckets of the default extractor (names are ours).
LINE_BUCKETS = ((40, "short"), (200, "medium"))


def extract_line_atoms(documents: DataFrame) -> DataFrame:
    """U1 default extractor: one atom per non-blank line of every document
    (whole texts), typed by line length. Pure built-ins: ``split`` +
    ``posexplode`` stay in the JVM and split one document per row, so a
    long document is never gathered with others."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.length("line")
    kind = F.when(n < LINE_BUCKETS[0][0], LINE_BUCKETS[0][1]) \
            .when(n < LINE_BUCKETS[1][0], LINE_BUCKETS[1][1]).otherwise("long")
    return (lines.where(F.trim("line") != "")
                 .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"),
                         kind.alias("atom_type"), n.cast("bigint").alias("n_chars")))


def extract_with(documents: DataFrame, fn: Callable, schema) -> DataFrame:
    """U1 hook: run a vectorised extractor over Arrow batches of documents
    (``mapInPandas``); each batch is a slice of one partition, so the work
    is spread over the whole cluster."""
    from runlens.session import ship_package
    ship_package(documents.sparkSession)
    return documents.mapInPandas(fn, schema)


# Fixed values of a call row of the default extractor (names are ours).
CALL_SOURCE, CALL_MODEL, CALL_MAX_TOKENS = "line_extractor", "rules-1", 1024


def extract_with_calls(documents: DataFrame, fn: Callable, atom_schema: str, path: str) -> tuple[DataFrame, DataFrame]:
    """U1 + P26: the (atoms, call rows) of an extractor that calls a model.
    ``fn(batch: pandas.DataFrame) -> (atoms, calls)`` runs once over the
    documents; both kinds of rows are written below ``path`` by the same tasks,
    so a call is never made again to read its row. A call row has ``doc_id,
    source, prompt_size, max_tokens, response_size, latency_sec, model``; its
    latency is rounded to 3 places."""
    import pandas as pd

    from runlens.session import ship_package
    spark = documents.sparkSession
    ship_package(spark)
    calls = "doc_id long, source string, prompt_size long, max_tokens long, response_size long, latency_sec double, model string"
    a, c = (spark.createDataFrame([], s).schema for s in (atom_schema, calls))
    both = (", ".join(f"a_{f.name} {f.dataType.simpleString()}" for f in a) + ", "
            + ", ".join(f"c_{f.name} {f.dataType.simpleString()}" for f in c) + ", kind string")

    def run(batches):
        for pdf in batches:
            atoms, made = fn(pdf)
            for kind, prefix, rows in (("atoms", "a_", atoms), ("calls", "c_", made)):
                yield (rows.add_prefix(prefix).assign(kind=kind)
                           .reindex(columns=[f"a_{n}" for n in a.names] + [f"c_{n}" for n in c.names] + ["kind"]).astype(object)
                           .where(lambda d: pd.notna(d), None))
    documents.mapInPandas(run, both).write.partitionBy("kind").parquet(path)
    stored = spark.read.parquet(path)
    atoms = stored.where("kind = 'atoms'").select(*[F.col(f"a_{n}").alias(n) for n in a.names])
    made = stored.where("kind = 'calls'").select(*[F.col(f"c_{n}").alias(n) for n in c.names])
    return atoms, made.withColumn("latency_sec", F.round("latency_sec", 3))


def run_counts(atoms: DataFrame) -> DataFrame:
    """A4: per deal, atoms, entities (distinct conversation x role), edges
    (consecutive turns present in a conversation) and packets (one per
    conversation). Edges are an equi-join on (conversation, turn + 1)."""
    base = atoms.select("deal_id", "conv_id", "turn", "role")
    nxt = base.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(1).alias("_has_next"))
    edges = (base.join(nxt, ["conv_id", "turn"], "left")
                 .groupBy("deal_id").agg(F.count("_has_next").alias("edges")))
    counts = base.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("atoms"),
        F.count_distinct("conv_id", "role").alias("entities"),
        F.count_distinct("conv_id").alias("packets"))
    return counts.join(edges, "deal_id")


def envelope_rollup(ui: DataFrame) -> DataFrame:
    """U2 default projection: per deal, counts and the sorted set of atom
    types (bounded by the type vocabulary, not by the deal's size)."""
    return ui.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("atoms"),
        F.count_if("verified").alias("verified_atoms"),
        F.array_join(F.array_sort(F.collect_set("atom_type")), ",").alias("atom_types"))


def project_with(atoms: DataFrame, by: str, partial: Callable, merge: Callable, finish: Callable, schema: str,
                 salts: int = 16) -> DataFrame:
    """U2 hook: a user's projection of all rows of a key, in parts, so that no
    task holds a key's rows. ``partial(rows: pandas.DataFrame) -> state`` gets
    a key's rows of one Arrow batch, ``merge(state, state) -> state`` must not
    depend on the order, ``finish(key, state) -> dict`` makes the key's row.
    A state is any value that pickles; its size is the user's to bound. A null
    key is a key."""
    import pickle

    import pandas as pd

    from runlens.session import ship_package
    ship_package(atoms.sparkSession)

    def parts(batches):
        for pdf in batches:
            got = [(None if pd.isna(k) else k, pickle.dumps(partial(rows))) for k, rows in pdf.groupby(by, dropna=False, sort=False)]
            yield pd.DataFrame({"key": pd.Series([k for k, _ in got], dtype=object), "state": [s for _, s in got]})

    def together(pdf):
        state = pickle.loads(pdf["state"].iloc[0])
        for s in pdf["state"].iloc[1:]:
            state = merge(state, pickle.loads(s))
        return state

    def merged(pdf):
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "state": [pickle.dumps(together(pdf))]})

    def last(pdf):
        key = pdf["key"].iloc[0]
        return pd.DataFrame([finish(None if pd.isna(key) else key, together(pdf))])
    kind = f"key {atoms.schema[by].dataType.simpleString()}, state binary"
    some = atoms.mapInPandas(parts, kind).withColumn("salt", F.pmod(F.xxhash64("state", F.monotonically_increasing_id()), F.lit(salts)))
    return some.groupBy("key", "salt").applyInPandas(merged, kind).groupBy("key").applyInPandas(last, schema)


def draft_markdown(rollup: DataFrame, by_type: DataFrame) -> DataFrame:
    """A markdown draft per deal; only the contract (text, version,
    length) is the reference's, the content is ours."""
    lines = by_type.groupBy("deal_id").agg(F.array_sort(F.collect_list(
        F.concat(F.lit("- "), F.col("atom_type"), F.lit(": "), F.col("atoms").cast("string"))))
        .alias("_lines"))
    j = rollup.join(lines, "deal_id")
    md = F.concat_ws("\n", F.concat(F.lit("# Draft for "), F.col("deal_id")),
                     F.concat(F.lit("Atoms: "), F.col("atoms").cast("string"),
                              F.lit(" (verified "), F.col("verified_atoms").cast("string"),
                              F.lit(")")),
                     F.array_join("_lines", "\n"))
    return j.select("deal_id", md.alias("markdown"), F.lit("v1").alias("version"),
                    F.length(md).cast("bigint").alias("n_chars"))


def atoms_by_artifact_nested(ui: DataFrame) -> DataFrame:
    """A3 nested form: per file, the total and the type counter as a map
    (``by_type``) plus its sorted text rendering. Counted per (file, type)
    first, so the collected list per file is bounded by the vocabulary."""
    f = F.when(F.col("source_filename") != "", F.col("source_filename")).otherwise(UNKNOWN_FILE)
    per = ui.withColumn("file", f).groupBy("file", "atom_type").agg(F.count(F.lit(1)).alias("n"))
    nested = per.groupBy("file").agg(
        F.sum("n").alias("atom_count"),
        F.map_from_entries(F.collect_list(F.struct("atom_type", "n"))).alias("by_type"),
        F.array_join(F.array_sort(F.collect_list(
            F.concat("atom_type", F.lit(":"), F.col("n").cast("string")))), ",").alias("by_type_text"))
    return nested
