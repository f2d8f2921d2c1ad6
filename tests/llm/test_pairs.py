"""Jaccard join, passages and decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import common, decontaminate, jaccard_join, substring_dedup
from runlens.llm.common import shingles, words
from runlens.llm.queries import QUERIES
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _set(t):
    w = _words(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(docs):
    sets = [_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(s), best.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def test_word_and_shingle_hashes():
    texts = ["The the\tTHE \x0b x", None, "", "a b c d e f", "É é ß\x1f k", "one two"]
    h, n = words(texts)
    assert n.tolist() == [len(_words(t)) for t in texts]
    assert len(set(h[:3].tolist())) == 1
    s, m = shingles(h, n)
    assert m.tolist() == [1, 0, 0, 2, 1, 1] and len(set(s.tolist())) == 5
    assert words([]) [1].tolist() == [] and words([None, ""])[1].tolist() == [0, 0]


def test_jaccard_query_equals_brute_force(spark, docs):
    want = _components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in QUERIES["op8_token_group_jaccard"](spark, SF).collect()), key=str) == want


def test_jaccard_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == _components([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_pairs_are_bounded_a_row_each(spark):
    """The counted prefix overlap of a pair is found with the pair as one row: no
    row per shared token is shuffled."""
    rnd = random.Random(5)
    sets = {k: (sorted(rnd.sample(range(40), 12)), rnd.randint(40, 60)) for k in range(30)}
    prefixes = spark.createDataFrame([(k, t) for k, (t, _) in sets.items()], "sid long, toks array<long>")
    rows = [(a, sets[a][1], sets[a][0][-1], b, sets[b][1], sets[b][0][-1]) for a in sets for b in sets if a != b]
    got = jaccard_join._bounded_pairs(spark.createDataFrame(rows, "a long, n int, last long, b long, nb int, lb long"), prefixes, 80, 100)
    want = {(max(a, b), min(a, b)) for a, n, last, b, nb, lb in rows
            if 180 * (len(set(sets[a][0]) & set(sets[b][0])) + -(-(n if last <= lb else nb) * 80 // 100) - 1) >= 80 * (n + nb)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 435
    assert "token" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("union", [4096, 3])
def test_jaccard_queries_are_bounded_a_row_each(spark, monkeypatch, union):
    """The overlap of a query with a group's union is found with the pair as one
    row (and one per part of a large union): no row per token is made of it."""
    monkeypatch.setattr(jaccard_join, "UNION", union)
    rnd = random.Random(6)
    sets = {k: (rnd.sample(range(40), 10), rnd.randint(40, 60)) for k in range(20)}
    unions = {g: (rnd.sample(range(40), 20), rnd.randint(40, 60)) for g in range(100, 115)}
    p = spark.createDataFrame([(k, t) for k, (ts, _) in sets.items() for t in ts], "sid long, token long")
    matrix = spark.createDataFrame([(g, t) for g, (ts, _) in unions.items() for t in ts], "gid long, token long")
    rows = [(q, sets[q][1], g, unions[g][1] - 2, unions[g][1]) for q in sets for g in unions]
    got = jaccard_join._bounded_queries(spark.createDataFrame(rows, "q long, n int, gid long, n0 int, n1 int"), p, matrix, F.col("n0"), 80, 100)
    want = {(q, g) for q, n, g, n0, n1 in rows
            if 180 * (len(set(sets[q][0]) & set(unions[g][0])) + -(-max(n, n1) * 80 // 100) - 1) >= 80 * (n + n0)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "token" in line for line in plan.splitlines())


@pytest.mark.parametrize("pivots", [0, 2])
def test_jaccard_chains_at_the_threshold(spark, monkeypatch, pivots):
    """Sets around the threshold, in chains and groups of near copies. With no
    useful pivot everything has to come out of the matrix."""
    rnd = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rnd.randint(5, 60))]
        for c in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 18))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
            docs.append((len(docs), " ".join(w[rnd.randint(0, 2):])))
            base = w if c % 3 == 0 else base
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links, asked = jaccard_join._linked_pairs, []

    def linked(*args):
        asked.append(args[3])
        found = links(*args)
        return found.limit(0) if args[3] == "star" and not pivots else found
    monkeypatch.setattr(jaccard_join, "_linked_pairs", linked)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == _components(docs)
    assert asked == ["star", "matrix"]


def test_jaccard_token_that_unlinked_sets_share(spark):
    """One prefix token held by every set, none of which link: nothing is left to meet."""
    docs = [(i, f"x{i} a b c d e f g h") for i in range(400)] + [(500, "b c d e f g h i j k l"), (501, "b c d e f g h i j k l m")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str) == _components(docs)
    posts = spark.createDataFrame([(7, i, 5, 1, 9, i) for i in range(1000)], "token long, sid long, n int, pos int, last long, comp long")
    assert jaccard_join._within_reach(common.staged(posts, "test"), 80, 100).count() == 0


def test_jaccard_compares_whole_tokens(spark, monkeypatch):
    """Tokens that differ in their upper bits only are different."""
    sets = jaccard_join._sets
    upper = np.uint64(32)

    def high(texts):
        s, n = sets(texts)
        return s >> upper << upper, n
    monkeypatch.setattr(jaccard_join, "_sets", high)
    # two documents share their rarest tokens, and so their prefixes, but not the frequent rest
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = []
    for g in range(5):
        for side in "ab":
            docs.append((len(docs), run(f"g{g}same", 24) + " " + run(f"g{g}{side}", 30)))
            docs += [(len(docs) + k, run(f"g{g}{side}", 30) + " " + run(f"g{g}{side}{k}own", 40)) for k in range(12)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _components(docs)


def _repeats(docs, length):
    """Per document the word positions covered by runs of ``length`` words
    that another document holds."""
    who, cover = defaultdict(set), defaultdict(set)
    for d, t in docs:
        w = _words(t)
        for i in range(len(w) - length + 1):
            who[tuple(w[i:i + length])].add(d)
    for d, t in docs:
        w = _words(t)
        for i in range(len(w) - length + 1):
            if len(who[tuple(w[i:i + length])]) > 1:
                cover[d].update(range(i, i + length))
    return cover


def _covered(rows):
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return got


def test_passages_cover_all_exact_repeats(spark, docs):
    want = _repeats([(r.doc_id, r.text) for r in docs.collect()], 50)
    rows = QUERIES["op9_compact_windows"](spark, SF).collect()
    got = _covered(rows)
    assert want and all(want[d] <= got[d] for d in want)
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.other_doc != r.doc_id for r in rows)


def test_planted_passages_are_found_and_nothing_else(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(f"t{rnd.randrange(10 ** 7)}" for _ in range(n))
    passage, common = text(60), text(20)
    near = passage.split()
    near[30] = "changed"
    docs = [(i, text(150) + " " + common + " " + text(100)) for i in range(30)]          # 20 words are too few
    docs += [(100 + i, text(70) + " " + passage + " " + text(30 * i)) for i in range(12)]
    docs += [(200, text(99) + " " + " ".join(near) + " " + text(10))]
    got = _covered(substring_dedup.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert set(got) == {100 + i for i in range(12)} | {200}
    assert all(got[100 + i] == set(range(70, 130)) for i in range(12))
    assert got[200] == set(range(99, 159))


def test_passages_around_frequent_lines(spark):
    """Two documents share a passage around a line that unrelated documents of
    lower and of higher ids hold: those are the pivots of the line's keys."""
    rnd = random.Random(7)
    text = lambda n: " ".join(f"t{rnd.randrange(10 ** 7)}" for _ in range(n))
    docs, want = [], {}
    for g in range(12):
        line = text(30 + g)
        docs += [(1000 * k + 10 * g, text(20 + k) + " " + line + " " + text(20)) for k in (0, 1, 8, 9)]
        passage = text(10) + " " + line + " " + text(10)
        for d in (5000 + 10 * g, 5001 + 10 * g):
            docs.append((d, text(25) + " " + passage + " " + text(25)))
            want[d] = set(range(25, 75 + g))
    got = _covered(substring_dedup.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == want


@pytest.mark.parametrize("length", [60, 75, 90])
def test_near_passages_around_frequent_lines(spark, length):
    """Pairs of passages with one word edited, around a line of 40 words that
    60 unrelated documents hold: no run of 50 words need be equal, and the
    line's keys meet unrelated documents first and last."""
    rnd = random.Random(length)
    text = lambda n: " ".join(f"t{rnd.randrange(10 ** 7)}" for _ in range(n))
    line = text(40)
    docs = [(d, text(30) + " " + line + " " + text(30)) for d in [*range(30), *range(9000, 9030)]]
    pairs = []
    for g in range(300):
        at = rnd.randint(0, length - 40)
        passage = (text(at) + " " + line + " " + text(length - 40 - at)).split()
        other = list(passage)
        other[rnd.randrange(length)] = "edited"
        a, b = 1000 + 2 * g, 1001 + 2 * g
        docs += [(a, text(25) + " " + " ".join(passage) + " " + text(25)), (b, text(31) + " " + " ".join(other) + " " + text(9))]
        pairs.append((a, b))
    rows = substring_dedup.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_doc) for r in rows}
    assert found <= {p for a, b in pairs for p in ((a, b), (b, a))}
    assert sum((a, b) in found and (b, a) in found for a, b in pairs) >= 0.95 * len(pairs)
    assert all(r.class_id == min(r.doc_id, r.other_doc) and r.others == 1 for r in rows)


def test_classes_of_passages(spark):
    """Documents that passages connect in a chain are one class, rows without
    an id are its smallest document."""
    rnd = random.Random(9)
    text = lambda n: " ".join(f"t{rnd.randrange(10 ** 7)}" for _ in range(n))
    one, two, three = text(60), text(70), text(55)
    docs = [(5, one + " " + text(30)), (3, text(8) + " " + one + " " + text(9) + " " + two), (8, two), (8, two), (2, text(200)),
            (None, three), (1, text(5) + " " + three)]
    rows = substring_dedup.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in rows} == {(5, 3), (3, 3), (8, 3), (None, None), (1, None)}


def test_passages_repeated_inside_a_text(spark):
    """A passage that a text holds many times, and one of a period below its
    length: every occurrence is a span."""
    rnd = random.Random(8)
    text = lambda n: " ".join(f"t{rnd.randrange(10 ** 7)}" for _ in range(n))
    passage = text(60)
    docs = [(1, " ".join(passage + " " + text(7) for _ in range(5))), (2, text(40) + " " + passage + " " + text(9)),
            (3, text(12) + " " + "a b c " * 100 + text(5)), (4, "a b c " * 20 + text(30))]
    got = _covered(substring_dedup.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got[1] >= {67 * k + j for k in range(5) for j in range(60)} and got[2] == set(range(40, 100))
    assert got[3] >= set(range(12, 312)) and got[4] >= set(range(60))


def test_passages_odd_rows(odd, empty):
    rows = substring_dedup.near_duplicate_passages(odd).collect()
    got = _covered(rows)
    assert {4, 5, 8, 9, 12, 13} <= set(got) and not {1, 2, 3, 6, 7, 10, 11} & set(got)
    assert got[4] >= set(range(30_000))
    assert substring_dedup.near_duplicate_passages(empty).count() == 0


def test_compact_windows_partition_all_long_subsequences():
    """Every subsequence of t shingles or more lies in exactly one window
    around its rightmost minimum."""
    rnd = np.random.default_rng(4)
    tok = rnd.integers(0, 1 << 60, 90).astype(np.uint64)
    t = 12
    c, who, key = substring_dedup.centres(tok, np.array([90]), t, 0)
    left, right = substring_dedup.spans(tok, c, 0)
    v = substring_dedup.mix(tok ^ substring_dedup._SEEDS[0])
    for a in range(90):
        for b in range(a + t - 1, 90):
            m = a + int(np.argmin(v[a:b + 1]))
            assert [(x, left[k] <= a, right[k] >= b) for k, x in enumerate(c) if left[k] <= a <= x <= b <= right[k]] == [(m, True, True)]


def _edits(item, text):
    """Fewest edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_equals_edit_distance(spark):
    rnd = random.Random(2)
    letters = "abcdefg "
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    items = [(i, text(rnd.randint(30, 90)).strip()) for i in range(6)]
    docs = []
    for k in range(60):
        i, t = items[k % 6]
        t = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 9))):
            at = rnd.randrange(len(t))
            t[at:at + rnd.randint(0, 1)] = rnd.choice(["", "z", "y"])
        docs.append((k, text(rnd.randint(0, 200)) + "".join(t).upper() + text(rnd.randint(0, 50))))
    want = set()
    for d, t in docs:
        for i, x in items:
            m = decontaminate.normal(x)
            e = min(int(decontaminate.EDIT_RATE * len(m)), (len(m) - decontaminate.Q) // decontaminate.Q)
            got = _edits(m, decontaminate.normal(t))
            if got <= e:
                want.add((d, i, got))
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                             spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits) for r in found.collect()} == want and len(want) > 20


def test_decontamination_query_finds_exact_items(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench
            if decontaminate.normal(b.text) in decontaminate.normal(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in QUERIES["op2_qgram_decontamination"](spark, SF).collect()}


def test_decontamination_odd_rows_blocks_and_pieces(spark, odd, empty, monkeypatch):
    item = "a benchmark question that is long enough"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (None, "another question without any id"), (1, item)],
                                  "item_id long, text string")
    assert decontaminate.find_contamination(odd, bench).count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "w " * 3000 + item.upper() + " w" * 50), (2, "Another  question\nwithout any id"), (3, None)],
                                 "doc_id long, text string")
    want = {(1, 1, 0), (2, None, 0)}
    for block in (4_000_000, 40):
        got = decontaminate.find_contamination(docs, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got} == want
    monkeypatch.setattr(decontaminate, "PIECE_CHARS", 700)
    index = decontaminate.Index([(1, item)], decontaminate.Q, decontaminate.EDIT_RATE, 24)
    for n in range(500, 1500, 7):
        assert index.search("w " * n + item)[0][0] == 0


def test_short_benchmark_items_match_between_word_borders(spark):
    docs = [(1, "He said: Forty  Two. twice forty two"), (2, "forty twos and sixforty two"), (3, None), (None, "42?"), (4, "(42)"), (5, "142 420")]
    items = [(1, "forty two"), (2, " 42 "), (3, ""), (4, None), (5, "FORTY TWO")]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                           spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 0, 18), (1, 5, 0, 18), (None, 2, 0, 2), (4, 2, 0, 3)], key=str)


def test_shuffles_are_let_go_before_the_next_large_step(spark, docs, monkeypatch):
    """Shuffle files of a finished step do not add to those of the next."""
    for module, builds, steps in ((jaccard_join, lambda: jaccard_join.set_links(docs), {"jaccard-postings", "jaccard-placed", "jaccard-reach", "jaccard-matrix", "jaccard-queries"}),
                                  (substring_dedup, lambda: substring_dedup.near_duplicate_passages(docs), {"windows-keys", "windows", "windows-runs"})):
        seen = []
        write = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, write=write, seen=seen: seen.append(name) or write(df, name))
        monkeypatch.setattr(module, "release_shuffles", lambda s, seen=seen: seen.append(None))
        builds()
        assert {a for a, b in zip(seen, seen[1:]) if b is None} >= steps
