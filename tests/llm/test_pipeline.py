"""Each stage of the pipeline against its operator's plain meaning."""

import corpus_pipeline as P
from runlens.llm import decontaminate
from tests.llm.conftest import SF
from tests.llm.test_pairs import _components


def test_stages_in_order(spark, docs, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    at, rows = docs, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in at.collect()}
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.dtypes == docs.dtypes
        rows[name] = (before, at)
    before, after = rows["n-gram Jaccard join"]
    want = {d for d, _, c in _components(list(before.items())) if c == d}
    assert {r.doc_id for r in after.collect()} == want
    before, after = rows["benchmark decontamination"]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in before.items() if any(i in decontaminate.normal(t) for i in items)}
    assert {r.doc_id for r in after.collect()} == set(before) - leaks
    before, after = rows["line dedup"]
    assert {r.doc_id for r in after.collect()} == set(before)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = rows["best-fit packing"]
    assert {r.doc_id for r in after.collect()} == set(before)


def test_repeated_and_nameless_rows_are_decided(spark):
    """Rows of one id, rows without one, and copies under several names."""
    base = "some words of a text that is long enough to be compared with others of its kind"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(5, base), (5, base), (None, base), (3, base + " too"), (None, "quite another text without any name at all"),
            (None, "quite another text without any name at all"), (7, "")] + [(7, "")] + [(None, None), (None, f"before {item} after"), (9, item)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.one_of_each_group(spark, df, SF)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, base + " too"), (None, "quite another text without any name at all"), (7, ""), (7, ""), (None, None),
         (9, item)], key=str)
    assert sorted(((r.doc_id, r.text) for r in P.without_benchmark(spark, kept, SF).collect()), key=str) == sorted(
        [(3, base + " too"), (None, "quite another text without any name at all"), (7, ""), (7, ""), (None, None)], key=str)


def test_stages_take_odd_documents(spark, odd, empty, tmp_path):
    for j, at in enumerate((odd, empty)):
        for k, (name, stage) in enumerate(P.STAGES):
            if k == 0 and j == 0:
                continue  # sixteen odd rows are no sample to judge quality on; tests/llm/test_quality.py has them
            stage(spark, at, SF).write.parquet(f"{tmp_path}/{j}-{k}")
            at = spark.read.parquet(f"{tmp_path}/{j}-{k}")
        assert at.count() >= (j == 0)
