import numpy as np

from runlens.llm import quality
from runlens.llm.queries import QUERIES, held_out


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    test = [r for r in got.collect() if r.held_out]
    assert len(test) > 50
    assert np.mean([r.predicted == r.quality for r in test]) > 0.95
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_prior_estimate():
    rng = np.random.default_rng(0)
    pos = rng.normal(1, 1, (2000, quality.N_FEATURES))
    mixed = np.vstack((rng.normal(1, 1, (2100, quality.N_FEATURES)), rng.normal(-1, 1, (900, quality.N_FEATURES))))
    rng.shuffle(mixed)
    model = quality.fit(pos, mixed)
    assert 0.65 < model["prior"] < 0.78
    assert np.mean(quality.predict(model, rng.normal(1, 1, (500, quality.N_FEATURES))) > 0.5) > 0.97
    assert np.mean(quality.predict(model, rng.normal(-1, 1, (500, quality.N_FEATURES))) > 0.5) < 0.03


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (8, 1), (2, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    same = {r.score for r in got if r.text == "one two"}
    assert len(same) == 1
    assert {r.score for r in got if not r.text}.__len__() == 1  # null is scored as empty
    assert quality.score_quality(empty, labels).count() == 0
    nothing = quality.score_quality(odd.select("doc_id", "text"), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert {r[0] for r in odd.select(held_out()).collect()} <= {True, False}
