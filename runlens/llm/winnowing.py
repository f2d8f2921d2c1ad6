"""Operator 5: document fingerprints by winnowing.

Hashes of all k-grams of code points; in every window of ``w`` consecutive
ones the minimum is chosen, of equal ones the rightmost. Two texts that share
``w + k - 1`` code points share a chosen hash at the same place in them.
DataFrame and SQL expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 16        # code points of a gram
W = 85        # grams of a window: every shared run of 100 code points is seen
CHUNK = 8192  # windows whose grams are in memory at a time
TIES = 1024   # grams looked through for equal ones at a time
BUCKET_DOCS = 64      # documents of a bucket of neighbouring ids, about
MAX_BUCKETS = 1 << 15


def _winnow_grams(h: str, w: int) -> str:
    """SQL: the chosen (pos, h, f) of one array ``h`` of gram hashes, f the
    first window that chooses the gram. It goes from one chosen gram p to the
    next: the first later one not above it within reach of p's windows, else
    the rightmost minimum of the w grams behind p, else the end. Grams equal
    to p with nothing smaller between, as in texts that repeat themselves, are
    taken many at a time."""
    chosen = lambda q, f: f"named_struct('pos', {q}, 'h', element_at({h}, {q} + 1), 'f', {f})"
    one = lambda q, f: (f"transform(array({q}), q -> named_struct('p', q, 'v', element_at({h}, q + 1), 'go', true, "  # noqa: E731
                        f"'kept', concat(s.kept, array({chosen('q', f)}))))[0]")
    lower = "s.p + cast(array_position(transform(z, y -> y <= s.v), true) AS int)"
    right = f"s.p + {w + 1} - cast(array_position(reverse(z), least) AS int)"
    equal = f"""transform(array(slice({h}, s.p + 2, {TIES})), b -> transform(array(array_position(transform(b, y -> y < s.v), true)), cut ->
        filter(transform(b, (y, i) -> if(y = s.v AND (cut = 0 OR i + 1 < cut), i + 1, 0)), o -> o > 0))[0])[0]"""
    reached = f"""transform(array({equal}), o -> transform(array(array_position(transform(o, (x, i) ->
        i > 0 AND x - o[greatest(i - 1, 0)] > {w}), true)), gap -> if(gap = 0, o, slice(o, 1, cast(gap AS int) - 1)))[0])[0]"""
    many = f"""transform(array({reached}), o -> named_struct('p', s.p + element_at(o, -1), 'v', s.v, 'go', true, 'kept', concat(s.kept,
        transform(o, x -> named_struct('pos', s.p + x, 'h', s.v, 'f', s.p + x - {w - 1})))))[0]"""
    step = f"""transform(array(slice({h}, s.p + 2, {w})), z -> transform(array(array_min(z)), least ->
        CASE WHEN least < s.v THEN {one(lower, f'q - {w - 1}')} WHEN least = s.v THEN {many} WHEN size(z) = {w} THEN {one(right, 's.p + 1')}
             ELSE named_struct('p', s.p, 'v', s.v, 'go', false, 'kept', s.kept) END)[0])[0]"""
    first = f"""transform(array(slice({h}, 1, {w})), z -> transform(
        array(size(z) - cast(array_position(reverse(z), array_min(z)) AS int)), q ->
        named_struct('p', q, 'v', element_at({h}, q + 1), 'go', true, 'kept', array({chosen('q', '0')})))[0])[0]"""
    run = "aggregate(sequence(1, {n}), {zero}, (s, j) -> if(s.go, " + step + ", s))"
    most = run.format(n=f"2 + size({h}) * 3 div {w}", zero=first)
    # random hashes choose two grams in w + 1; a text that chooses more goes on to the end
    return f"transform(array({most}), r -> if(r.go, {run.format(n=f'size({h})', zero='r')}, r))[0].kept"


def winnow(x: str, k: int = K, w: int = W, chunk: int = CHUNK) -> str:
    """SQL: array<struct<pos int, h bigint, f int>> of the string ``x``.

    A text shorter than a gram is one gram, one shorter than a window one
    window; an empty one has none. Long texts are read in pieces of ``chunk``
    windows, so the memory of a row does not grow with its grams.
    """
    grams = f"regexp_extract_all(substring({x}, c * {chunk} + 1, {chunk + w + k - 2}), '(?s)(?=(.{{{k}}})).', 1)"
    piece = f"""transform(transform(array(transform({grams}, g -> xxhash64(g))), h -> {_winnow_grams('h', w)})[0],
        e -> named_struct('pos', e.pos + c * {chunk}, 'h', e.h, 'f', e.f + c * {chunk}))"""
    pieces = f"flatten(transform(sequence(0, greatest(0, (length({x}) - {w + k - 1}) div {chunk})), c -> {piece}))"
    # a gram chosen on both sides of a border counts once, from its first window on
    whole = f"transform(array({pieces}), a -> if(length({x}) - {w + k - 1} < {chunk}, a, filter(a, (e, i) -> i = 0 OR a[greatest(i - 1, 0)].pos < e.pos)))[0]"
    none = "cast(array() AS array<struct<pos: int, h: bigint, f: int>>)"
    return (f"CASE WHEN {x} = '' THEN {none} WHEN length({x}) < {k} "
            f"THEN array(named_struct('pos', 0, 'h', xxhash64({x}), 'f', 0)) ELSE {whole} END")


def likeness(a: str, b: str) -> str:
    """SQL: Jaccard similarity of the hashes of two fingerprints; two empty
    ones are alike."""
    one, two = (f"transform({v}, e -> e.h)" for v in (a, b))
    both = f"size(array_intersect({one}, {two}))"
    any_ = f"size(array_union({one}, {two}))"
    return f"if({any_} = 0, 1.0D, {both} / cast({any_} AS double))"


def as_text(v: str) -> str:
    """SQL: ``pos:hash`` of each chosen gram, in order."""
    return f"array_join(transform({v}, e -> concat(e.pos, ':', lower(hex(e.h)))), ' ')"


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the chosen grams of ``text`` (null: empty) in ``out``
    (a column of that name is replaced). Equal texts get equal ones."""
    return docs.withColumn(out, F.expr(winnow(f"coalesce(`{text}`, '')")))


def _buckets(ids: DataFrame) -> list[int]:
    """Ascending ids that cut the id range in about equal parts (at most
    ``MAX_BUCKETS``, whatever the input)."""
    n = ids.count()
    parts = min(MAX_BUCKETS, n // BUCKET_DOCS)
    if parts < 2:
        return []
    marks = [i / parts for i in range(1, parts)]
    got = ids.agg(F.percentile_approx("d", marks, 10 * parts)).first()[0] or []
    return sorted(set(got) - {ids.agg(F.min("d")).first()[0]})


def next_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, x, fp, nx, nfp): every document with its fingerprint and the text
    and fingerprint of the next one by ascending id (null first; of equal ids
    by text), the first after the last.

    Neighbouring ids share a bucket; the first document of a bucket is also
    sent to the one before as its end. One shuffle moves each text once, and
    no task needs more than its buckets.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    ids = rows.select("d")
    low = ids.agg(F.min("d").alias("low"), F.max(F.col("d").isNull()).alias("null")).first()
    bounds = _buckets(ids.filter("d IS NOT NULL"))
    side = max(1, round(len(bounds) ** 0.5))
    listed = f"cast(split('{','.join(map(str, bounds))}', ',') AS array<bigint>)" if bounds else "cast(array() AS array<bigint>)"
    coarse = bounds[::side]
    heads = f"cast(split('{','.join(map(str, coarse))}', ',') AS array<bigint>)" if bounds else listed
    at = f"(size(filter({heads}, b -> b <= d)) - 1)"
    bucket = (f"CASE WHEN d IS NULL OR {len(bounds)} = 0 OR {at} < 0 THEN 0 ELSE {at} * {side} "
              f"+ size(filter(slice({listed}, greatest({at}, 0) * {side} + 1, {side}), b -> b <= d)) END")
    placed = rows.withColumn("bucket", F.expr(bucket))
    starts = F.expr(f"bucket > 0 AND d = element_at({listed}, greatest(bucket, 1))") if bounds else F.lit(False)
    is_first = F.col("d").isNull() if low["null"] else (F.col("d") == F.lit(low["low"]))
    copies = F.filter(F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("end")),
        F.when(starts, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("end"))),
        F.when(is_first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("end")))), lambda c: c.isNotNull())
    sent = placed.select("d", "x", F.explode(copies).alias("c")).select("d", "x", "c.bucket", "c.end")
    dealt = sent.repartition("bucket").withColumn("fp", F.expr(winnow("x")))
    w = Window.partitionBy("bucket").orderBy("end", F.col("d").asc_nulls_first(), "x")
    nxt = F.lead(F.struct("x", "fp")).over(w)
    return (dealt.withColumn("nxt", nxt).filter("end = 0")
                 .select("d", "x", "fp", F.col("nxt.x").alias("nx"), F.col("nxt.fp").alias("nfp")))


def edited(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``etext`` (the last half of the code points replaced by
    the first as many, or all, of the next text) and its fingerprint ``efp``.

    Windows that lie wholly in one of the two parts chose the same grams in
    their own texts, so only the windows across the joint are hashed anew.
    """
    t = W + K - 1
    p = (pairs.withColumn("n", F.length("x"))
              .withColumn("a", F.expr("n - n div 2")).withColumn("b", F.expr("least(n div 2, length(nx))"))
              .withColumn("etext", F.expr("concat(left(x, a), left(nx, b))"))
              .withColumn("joint", F.expr(f"substring(etext, greatest(a - {t - 1}, 0) + 1, least(a, {t - 1}) + least(b, {t - 1}))")))
    p = p.withColumn("across", F.expr(winnow("joint")))
    p = (p.withColumn("own", F.expr(f"filter(fp, e -> e.f <= a - {t})"))
          .withColumn("new", F.expr(f"transform(filter(nfp, e -> e.f <= b - {t}), e -> named_struct('pos', e.pos + a, 'h', e.h, 'f', e.f + a))"))
          .withColumn("at", F.expr("transform(concat(own, new), e -> e.pos)")))
    mid = f"if(a + b >= {t} AND length(joint) < {t}, slice(across, 1, 0), transform(across, e -> named_struct('pos', e.pos + greatest(a - {t - 1}, 0), 'h', e.h, 'f', e.f)))"
    return p.withColumn("efp", F.expr(f"sort_array(concat(own, filter({mid}, e -> NOT array_contains(at, e.pos)), new))"))


def fingerprint_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, its edited text's, and how alike they and
    the next document's are. Null texts are empty; rows of equal ids follow
    each other by text; other columns are not read."""
    p = edited(next_pairs(docs, doc_id, text))
    return p.select(F.col("d").alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"),
                    F.sha2(F.col("etext").cast("binary"), 256).alias("edited_sha256"),
                    F.expr(as_text("fp")).alias("fingerprint"), F.expr(as_text("efp")).alias("edited_fingerprint"),
                    F.expr(likeness("fp", "efp")).alias("near_edited"), F.expr(likeness("fp", "nfp")).alias("near_next"))
