import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import packing
from runlens.llm.queries import QUERIES, tokenizer_path
from tests.llm.conftest import SF


def _pieces(texts, capacity=packing.CAPACITY):
    t = Tokenizer.from_file(tokenizer_path())
    out = []
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        for k in range(0, len(ids), capacity):
            p = ids[k:k + capacity]
            out.append((d, k // capacity, k, len(p), zlib.crc32(p.tobytes())))
    return sorted(out, key=str)


def _check(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_query_cuts_and_packs(spark, docs):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == _pieces([(r.doc_id, r.text) for r in docs.collect()])
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert _check(rows) <= 1.02 * least + 1


def _best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            k = min(fits, key=lambda k: gaps[k])
            gaps[k] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_close_to_best_fit_decreasing(spark):
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 100, 700), rng.integers(30, 60, 300), np.full(500, 33), rng.geometric(0.05, 2000).clip(1, 99)):
        df = spark.createDataFrame([(int(s), int(n)) for s, n in Counter(sizes.tolist()).items()], "length int, n long")
        runs, bins = packing.best_fit(df, 100)
        used, placed = Counter(), 0
        for r in runs.collect():
            for j in range(r.n):
                used[r.bin + j // r.k] += r.size
                placed += 1
        assert placed == len(sizes) and max(used.values()) <= 100 and len(used) == bins
        assert bins <= 1.02 * _best_fit_decreasing(sizes.tolist(), 100) + 1


def test_encoder_equals_the_tokenizer():
    with open(tokenizer_path()) as f:
        definition = f.read()
    enc, t = packing.Encoder(definition), Tokenizer.from_str(definition)
    texts = ["Plain words, and 'quotes' don't split we'll.", "ÉTÉ straße İstanbul ΣΊΣΥΦΟΣ ΟΔΟΣ", "a<|endoftext|>b <|STARTOFTEXT|>", "日本 🙂 x y\x1cz",
             "é combining ñ ́lead", "tabs\tand\r\nlines\x0bv", "word... word?! ###a*** 123 4a b5", " ", "", None, "\x00\x01", "ﬁ ﬂ ½ ² ʰ"]
    for x in texts * 2:
        assert enc.encode(x) == np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes(), x


def test_small_cache_gives_the_same(monkeypatch, docs):
    with open(tokenizer_path()) as f:
        definition = f.read()
    t, enc = Tokenizer.from_str(definition), packing.Encoder(definition)
    enc.words.clear()
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    for r in docs.limit(5).collect():
        assert enc.encode(r.text) == np.array(t.encode(r.text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    enc.words.clear()


def test_odd_rows(odd, empty):
    rows = packing.pack(odd, tokenizer_path()).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == _pieces([(r.doc_id, r.text) for r in odd.collect()])
    _check(rows)
    assert packing.pack(empty, tokenizer_path()).count() == 0
    small = packing.pack(odd.select("doc_id", F.lit("one two three").alias("text")), tokenizer_path(), capacity=8).collect()
    assert _check(small, 8) == -(-odd.count() // 2)
