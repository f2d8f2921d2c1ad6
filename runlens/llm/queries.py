"""The ``opN_<name>`` queries: each applies its operator, with the parameters
of production, to its whole table, and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, common, decontaminate, html_extract, jaccard_join, line_dedup, lloyd, packing, quality, sharding, spelling, substring_dedup, warc, winnowing
from runlens.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f
    return add


@_query("""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER w AS pos,
             string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2), '') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                          ROWS UNBOUNDED PRECEDING)),
e AS (SELECT prefix, max(n) AS turns, min(conv_id) AS conv_id, count(*) AS copies
      FROM (SELECT conv_id, max(pos) AS n, arg_max(prefix, pos) AS prefix FROM p GROUP BY conv_id) GROUP BY prefix),
l AS (SELECT p.prefix FROM p JOIN (SELECT conv_id, max(pos) AS n FROM p GROUP BY conv_id) m USING (conv_id) WHERE p.pos < m.n),
k AS (SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM l))
SELECT k.conv_id, ((p.pos - 1) // 256)::INT AS part, count(*)::INT AS n_turns, max(k.turns)::INT AS turns,
       max(k.copies)::BIGINT AS copies,
       string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS text
FROM k JOIN p USING (conv_id) GROUP BY 1, 2""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


@_query()
def op3_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("block"))
    placed = sharding.reshard(docs, "block", new_shards=8, old_shards=5)
    digest = placed.select("doc_id", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
                           "shard")
    return sharding.with_slots(digest).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@_query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return quality.score_quality(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query()
def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archive(read_table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return warc.read_frames(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT DISTINCT text, source, trim(l, ' ') AS line FROM (SELECT text, source, unnest(ls) AS l FROM d) WHERE trim(l, ' ') <> ''),
b AS (SELECT c.source, list(c.line) AS lines FROM (SELECT source, line, count(*) AS n FROM x GROUP BY ALL) c
      JOIN (SELECT source, count(DISTINCT text) AS pages FROM d GROUP BY 1) p ON c.source IS NOT DISTINCT FROM p.source
      WHERE c.n >= 3 AND c.n > 0.005 * p.pages GROUP BY 1),
j AS (SELECT d.*, coalesce(b.lines, []) AS lines FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(list_filter(ls, lambda l: trim(l, ' ') <> '')), 0)::INT AS n_lines,
       coalesce(len(list_filter(ls, lambda l: trim(l, ' ') <> '' AND list_contains(lines, trim(l, ' ')))), 0)::INT AS n_dropped,
       array_to_string(list_filter(ls, lambda l: NOT (trim(l, ' ') <> '' AND list_contains(lines, trim(l, ' ')))), chr(10)) AS text
FROM j""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


@_query()
def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                            read_table(spark, sf_dir, "benchmark"))


@_query()
def op8_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query()
def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_duplicate_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query()
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@_query()
def op13_prefix_suffix_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query(lloyd.oracle_sql())
def op11_dimension_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query()
def op12_minimum_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")
