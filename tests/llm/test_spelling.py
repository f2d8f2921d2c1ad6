"""Operator 13 against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from runlens.llm import spelling


def _edits(word: str, alphabet: str) -> set:
    near = {word[:i] + word[i + 1:] for i in range(len(word))}
    for c in alphabet:
        near |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
        near |= {word[:i] + c + word[i + 1:] for i in range(len(word))}
    return near - {word}


def plain(docs) -> list:
    count: Counter = Counter()
    low = {i: i + 32 for i in range(65, 91)}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    alphabet, forms, near = "".join(sorted({c for w in words if len(w) < 100 for c in w})), {}, {}
    for w, n in words.items():
        if len(w) < 100:
            near[w] = [v for v in _edits(w, alphabet) if v in words]
        else:
            near[w] = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and _one_edit(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return sorted(out)


def _one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def run(df) -> list:
    return sorted(tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows)
    assert len(want) > 1000 and sum(r[1] is not None for r in want) > 10
    assert run(docs) == want


@pytest.mark.parametrize("tile", [2, 32])
def test_dense_blocks(spark, monkeypatch, tile):
    """Short words over a small alphabet: blocks of many tiles, chains of forms,
    ties, insertions at either end, and words of hundreds of letters."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abéz") for _ in range(rnd.randint(4, 7))) for _ in range(900)]
    long = "".join(rnd.choice("abc") for _ in range(700))
    pool += [long, long[:350] + long[351:], long + "x", "y" + long, long[:10] + "q" + long[11:]]
    docs = [(i, " ".join(rnd.choice(pool) + rnd.choice(("", ",", "Ā", "1", "—")) for _ in range(300))) for i in range(60)]
    docs += [(100 + k, " ".join([w] * 3 * 4 ** k)) for k, w in enumerate(("kkkkk", "kkkkkk", "kkkkkkk"))]
    docs += [(200 + i, f"{w} " * (3 + i % 2)) for i, w in enumerate(pool[-5:])]
    want = plain(docs)
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(len(r[0]) > 500 and r[4] for r in want)
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_odd_rows(spark, odd, empty):
    assert run(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert run(empty) == []
    joined = [(1, "ÃÃÃÃÃ"), (2, "abcde"), (3, "fghij"), (None, "ABCDE abcde"), (5, "日abcde日"), (6, "")]
    assert run(spark.createDataFrame(joined * 3, "doc_id long, text string")) == plain(joined * 3)


def test_pieces(spark, docs, monkeypatch):
    """Counting piece by piece gives the same counts."""
    whole = sorted(map(tuple, spelling.word_counts(docs).collect()))
    monkeypatch.setattr(spelling, "PIECE", 1000)
    monkeypatch.setattr(spelling, "VECTOR", 6)
    assert sorted(map(tuple, spelling.word_counts(docs).collect())) == whole
