"""Chat formatting, line dedup and winnowing: DataFrame operations only."""

import hashlib

import pytest
import xxhash

from runlens.llm import chat, line_dedup, winnowing
from runlens.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    from runlens.plans import check, registry
    registry.QUERIES[name], registry.ORACLE[name] = QUERIES[name], ORACLE[name]
    try:
        got = check.compare(spark, SF, name)
    finally:
        del registry.QUERIES[name], registry.ORACLE[name]
    assert got["columns_match"] and got["match"], got


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op5_winnowing", "op10_line_dedup"])
def test_plan_has_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if x in plan]


def test_chat_snapshots_collapse(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
         (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),          # 1 is a prefix of 2
         (3, 5, "user", "hi"), (3, 7, "assistant", "yo"), (3, 9, "user", "more"),           # equals 2
         (4, 0, "user", "hi"), (4, 1, "assistant", "no"),                                   # differs
         (5, 0, "assistant", "hi"), (5, 0, "assistant", "hi"),                              # a repeated row is one turn
         (6, None, None, None), (None, 0, "user", "no id"), (7, 0, "user", ""), (8, 0, "user", None)]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS conv")
    got = {r.conv_id: (r.turns, r.copies, r.text) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, None, 7, 8}
    assert got[2] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert got[5][:2] == (1, 1)
    assert got[6][2] == "<|im_start|>\n<|im_end|>\n"


def test_chat_long_conversation_has_parts(spark):
    df = spark.range(1000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    got = sorted(chat.format_chats(df, part_turns=300).collect(), key=lambda r: r.part)
    assert [r.n_turns for r in got] == [300, 300, 300, 100]
    assert "".join(r.text for r in got).count("<|im_start|>") == 1000


def test_chat_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.drop_boilerplate(odd, ratio=0.5, min_pages=2)
    assert [c for c in got.columns if c in odd.columns] and got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, r)
    assert by[1].text is None and by[2].text == "" and by[3].text == " \n\t "
    assert by[6].text == "one two" and by[6].n_dropped == 0   # twice the same page is one page
    assert by[7].text == "one two"                          # another host
    assert by[1].row == "clash"
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_headers_go_and_copies_stay(spark):
    """A header on a fiftieth of every host's pages goes; lines that only the
    copies of one page share, and lines of two pages, stay."""
    docs = []
    for h in range(4):
        docs += [(1000 * h + i, f"h{h}", ("All rights reserved\n" if i % 50 == 0 else "") + f"own line {h} {i}\nsecond {h} {i // 2}") for i in range(300)]
        docs += [(1000 * h + 500 + i, f"h{h}", "All rights reserved\ncopied line\nanother one") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    for i, _, text in docs:
        assert got[i].text == text.replace("All rights reserved\n", "") and got[i].n_dropped == text.count("All rights")


def test_line_ratio_is_per_host(spark):
    rows = [(i, "menu\nbody %d" % i, "big") for i in range(10)] + [(20 + i, "menu\nbody %d" % i, "other") for i in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == "body 3" and got[20] == "menu\nbody 0"


def _hash(s):
    v = xxhash.xxh64(s.encode(), seed=42).intdigest()
    return v - (1 << 64) if v >> 63 else v


def _winnow(x, k=winnowing.K, w=winnowing.W):
    if not x:
        return []
    if len(x) < k:
        return [(0, _hash(x))]
    h, out = [_hash(x[i:i + k]) for i in range(len(x) - k + 1)], []
    for s in range(max(1, len(h) - w + 1)):
        z = h[s:s + w]
        p = s + len(z) - 1 - z[::-1].index(min(z))
        if not out or out[-1][0] != p:
            out.append((p, h[p]))
    return out


def _near(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def _text(f):
    return " ".join(f"{p}:{h & (1 << 64) - 1:x}" for p, h in f)


def _check_report(df):
    docs = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    marks = [_winnow(t) for _, t in docs]
    want = []
    for i, (d, t) in enumerate(docs):
        j, n = (i + 1) % len(docs), len(t)
        e = t[:n - n // 2] + docs[j][1][:n // 2]
        m = _winnow(e)
        want.append((d, n, hashlib.sha256(e.encode()).hexdigest(), _text(marks[i]), _text(m), _near(marks[i], m), _near(marks[i], marks[j])))
    got = [tuple(r) for r in winnowing.fingerprint_report(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_winnowing_equals_brute_force(docs):
    _check_report(docs.filter("doc_id < 60"))  # a small fixture of the test, not of the query


def test_winnowing_odd_rows(odd, empty, spark):
    _check_report(odd.filter("doc_id IS NULL OR doc_id NOT IN (4, 5)"))
    _check_report(odd.filter("doc_id = 4"))
    assert winnowing.fingerprint_report(empty).count() == 0


def test_winnowing_sees_shared_runs_of_100_code_points(spark):
    """The length is a literal here: the guarantee must not move with W."""
    import random
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    pairs = []
    for k in range(400):
        run = text(100)
        pairs += [(k, text(k) + "<" + run + ">" + text(150)), (k, text(140) + "[" + run + "]" + text(400 - k))]
    got = {}
    for r in spark.createDataFrame(pairs, "k int, x string").selectExpr("k", f"{winnowing.winnow('x')} AS fp").collect():
        got.setdefault(r.k, []).append({e.h for e in r.fp})
    assert len(got) == 400 and all(one & two for one, two in got.values())
    assert winnowing.W + winnowing.K - 1 <= 100


def test_winnowing_pieces_of_long_texts(spark):
    import random
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab c") for _ in range(n)) for n in (300, 399, 400, 401, 1500)] + ["a" * 900, "ab" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("x", f"{winnowing.winnow('x', 8, 20, 100)} AS fp")
    for r in df.collect():
        assert [(e.pos, e.h) for e in r.fp] == _winnow(r.x, 8, 20)
