"""Sinks that survive retries, and the text rules at their edges."""

import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.functions import decode as D
from runlens.functions.text import blank_to_null, py_strip
from runlens.operators import drafts, health
from runlens.session import build_session, ensure_checkpoint_dir  # noqa: F401
from runlens.sources import documents as DO
from runlens.sources import files as FS
from runlens.sources import versioned as VE


def _rows(spark, v, ids):
    return spark.createDataFrame([(f"d{i}", v, i) for i in ids], "deal_id string, version int, x long")


def test_upsert_keeps_untouched_rows_and_its_bucket_count(spark):
    path = tempfile.mkdtemp(prefix="upsert-") + "/t"
    VE.upsert_by_key(spark, path, _rows(spark, 1, range(50)), buckets=5)
    before = VE.read_versioned(spark, path)
    VE.upsert_by_key(spark, path, _rows(spark, 2, range(10, 20)), compile_id=F.lit("c2"), buckets=9)  # the table's own count stays
    VE.upsert_by_key(spark, path, _rows(spark, 0, range(20, 30)))                                     # older versions lose
    got = {r.deal_id: (r.version, r.compile_id) for r in VE.read_versioned(spark, path).collect()}
    assert len(got) == 50 and all(got[f"d{i}"] == ((2, "c2") if 10 <= i < 20 else (1, None)) for i in range(50))
    assert VE._Store(spark, path).newest()[1]["buckets"] == 5
    assert {r.version for r in before.collect()} == {1} and before.count() == 50   # a reader of the old version keeps it


def test_half_an_update_is_never_seen(spark, monkeypatch):
    """An update that fails before its version file leaves the table as it was;
    one that comes second starts again from the first one's version."""
    path = tempfile.mkdtemp(prefix="upsert-") + "/t"
    VE.upsert_by_key(spark, path, _rows(spark, 1, range(8)))
    commit = VE._Store.commit
    with monkeypatch.context() as m:
        m.setattr(VE._Store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            VE.upsert_by_key(spark, path, _rows(spark, 2, range(8)))
    assert {r.version for r in VE.read_versioned(spark, path).collect()} == {1}
    late = []

    def second(self, n, version):
        if not late:
            late.append(n)
            monkeypatch.setattr(VE._Store, "commit", commit)
            VE.upsert_by_key(spark, path, _rows(spark, 3, [0]))
        return commit(self, n, version)
    monkeypatch.setattr(VE._Store, "commit", second)
    assert VE.upsert_by_key(spark, path, _rows(spark, 2, [0, 1])) == 3
    got = {r.deal_id: r.version for r in VE.read_versioned(spark, path).collect()}
    assert got["d0"] == 3 and got["d1"] == 2 and got["d2"] == 1


def test_unreadable_table_is_an_error(spark):
    path = tempfile.mkdtemp(prefix="broken-")
    with open(path + "/part-0.parquet", "w") as f:
        f.write("this is no table")
    with pytest.raises(Exception):
        VE.upsert_by_key(spark, path, spark.createDataFrame([("d", 1)], "deal_id string, version int"))


def test_stage_lists_of_either_form(spark):
    docs = {"live": '{"stages": [{"stage_name": "parse", "duration_ms": 1.5, "input_count": 2, "output_count": 3}, {"stage_name": "score"}]}',
            "trace": '{"parser_trace": {"stages": [], "events": [{"stage": "a", "counts": {"x": 4}, "warning_count": 1}, 7, {"stage": "b", "error_count": 2}]}}',
            "none": '{"stages": "x"}', "text": '"x"'}
    df = spark.createDataFrame(list(docs.items()), "compile_id string, doc string").withColumn("doc", F.try_parse_json("doc"))
    got = {(r.compile_id, r.pos): (r.stage, r.duration_ms, dict(r.counts), r.warning_count, r.error_count) for r in DO.stage_rows(df).collect()}
    assert got == {("live", 1): ("parse", 1.5, {"input": 2, "output": 3}, 0, 0), ("live", 2): ("score", 0.0, {}, 0, 0),
                   ("trace", 1): ("a", 0.0, {"x": 4}, 1, 0), ("trace", 2): ("b", 0.0, {}, 0, 2)}


def test_status_batch_written_twice_counts_once(spark):
    path = tempfile.mkdtemp(prefix="status-") + "/t"
    ev = spark.createDataFrame([("c", "running")], "compile_id string, status string").withColumn("updated_at", F.timestamp_seconds(F.lit(5)))
    for batch in (1, 1, 2):
        FS.write_status_events(ev, path, batch)
    assert spark.read.parquet(path).count() == 2


def test_markers_are_objects_only(spark):
    path = tempfile.mkdtemp(prefix="markers-") + "/m"
    lines = ['{"compile_id": "a"}', '[{"compile_id": "b"}]', '{"compile_id": "c', '"x"', "7", "", "null"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    assert [r.compile_id for r in FS.read_markers(spark, path).collect()] == ["a"]


def test_strip_is_pythons(spark):
    texts = ["\t", " a\n", "\x1c　b ", "", None, "a b", "\x85\xa0", "x\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", py_strip("t").alias("s"), blank_to_null("t").alias("n")).collect()
    for r in got:
        want = None if r.t is None else r.t.strip()
        assert r.s == want and r.n == (want or None)


def test_percent_decode_leaves_stray_signs(spark):
    from urllib.parse import unquote
    urls = ["https://h/c/100%/a%20b.txt", "https://h/c/x%zz%41+y", "https://h/c/plain", "https://h/c/%"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", D.blob_path("u").alias("p")).collect()
    for r in got:
        assert r.p == unquote(r.u.split("/c/")[1])


def test_draft_deal_id_must_end_there(spark):
    good = "0" * 36
    got = spark.createDataFrame([(good,), (good + "\n",)], "d string").select(F.col("d").rlike(drafts.DEAL_ID_PATTERN).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False]


def test_route_peek_ignores_leading_white_space(spark):
    df = spark.createDataFrame([('\n\t{"kind": "x"}',)], "content string")
    row = D.decode_stage(df).select(F.col("_v").isNotNull().alias("v"), F.col("_peek").isNotNull().alias("p")).first()
    assert row.v and row.p


def test_cancel_stays_in_its_deal(spark):
    active = spark.createDataFrame([("d1", "c1", 1), ("d2", "c2", 1)], "deal_id string, compile_id string, t long") \
        .withColumn("updated_at", F.timestamp_seconds("t"))
    req = spark.createDataFrame([(1, "d1", "c2"), (2, "d1", " c1 "), (3, "d2", "\t"), (4, "d2", "")],
                                "request_id long, deal_id string, compile_id string")
    assert {r.request_id: r.cancelled_run for r in health.cancel_match(req, active).collect()} == {1: None, 2: "c1", 3: "c2", 4: "c2"}


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
