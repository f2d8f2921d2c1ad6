"""Operator 13: spelling variants by dense prefix-suffix tiling.

Two words are one edit apart when their common prefix and their common suffix
together reach the longer length minus one. An edit at position p of a word
leaves everything before p and everything behind it as it was, so the possible
positions are cut into intervals of ``WIDTH``, and two words with their edit in
an interval agree on all code points outside it. The steps:

1. Words are counted: one scan, a table of counts per piece of a batch, one
   map-side combined aggregation.
2. Every word gets a key per interval, once as the shorter and once as the
   longer word of a pair. Words of one key form a block; all they differ in is
   the few code points of the interval, which a padded matrix holds.
3. A task reads its blocks in the order of their keys, cuts them into tiles
   and compares tiles in pairs: a block with more words is more tiles, and the
   words of a block cannot be more than the alphabet fills an interval with.
   A pair is counted in the interval of its first difference, and so once.
4. Chains of forms are followed by pointer doubling.

No pair leaves a task: what does is, per word and block, the number of near
words and the best one.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import mix, staged

MOD = 97                  # a run whose crc32 this divides loses a code point
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2                 # a form occurs at least so many times as often
WIDTH = 2                 # positions in an interval
INTERVALS = 48            # a word has so many intervals at most: longer words have wider ones
TILE = 32
PIECE = 8 << 20           # bytes of text counted at a time in a task
CELLS = 1 << 22           # code points compared at a time in a task
VECTOR = 40               # longer runs (bytes) are hashed one by one

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _shorter(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _count_piece(ids: list, ends: np.ndarray, buf: np.ndarray) -> Counter:
    """Counts of the words of texts that lie one behind another in ``buf``
    (UTF-8), text i ending at ``ends[i]``."""
    out: Counter = Counter()
    if not len(buf):
        return out
    buf = _LOWER[buf]
    # U+00C0 to U+00FF are the byte C3 and one more
    inside = _LETTER[buf]
    inside[1:] |= buf[:-1] == 0xC3
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = np.concatenate(([0], ends[:-1]))
    heads = heads[heads < len(buf)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    if not len(start):
        return out
    stop = np.flatnonzero(inside & ~np.concatenate((inside[1:] & ~first[1:], [False]))) + 1
    size = stop - start
    doc = np.searchsorted(ends, start, side="right")
    seed = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids], np.uint32)
    short = np.flatnonzero(size <= VECTOR)
    order = short[np.argsort(-size[short], kind="stable")]
    at, crc = start[order], ~seed[doc[order]]
    same = np.zeros(len(order), np.uint64)
    longer = np.cumsum(np.bincount(size[order], minlength=VECTOR + 1)[::-1])[::-1]
    for j in range(VECTOR):
        k = int(longer[j + 1]) if j + 1 <= VECTOR else 0
        if not k:
            break
        b = buf[at[:k] + j]
        crc[:k] = _CRC[(crc[:k] ^ b) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
        same[:k] = mix(same[:k] * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(1))
    crc = ~crc
    cut = crc % np.uint32(MOD) == 0
    for i in np.flatnonzero(cut).tolist():
        a = int(at[i])
        out[_shorter(buf[a:a + int(size[order[i]])].tobytes().decode(), int(crc[i]))] += 1
    whole = np.flatnonzero(~cut)
    _, pick, n = np.unique(same[whole], return_index=True, return_counts=True)
    for a, z, c in zip(at[whole[pick]].tolist(), size[order[whole[pick]]].tolist(), n.tolist()):
        out[buf[a:a + z].tobytes().decode()] += c
    for i in np.flatnonzero(size > VECTOR).tolist():
        raw = buf[start[i]:stop[i]].tobytes()
        h = zlib.crc32(raw, int(seed[doc[i]]))
        w = raw.decode()
        out[_shorter(w, h) if h % MOD == 0 else w] += 1
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("x")).filter("x IS NOT NULL")

    def count(batches):
        for batch in batches:
            x = batch.column("x").cast(pa.large_binary())
            ids = batch.column("d").to_pylist()
            offs = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
            data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, side="right")) - 1)
                found = _count_piece(ids[lo:hi], offs[lo + 1:hi + 1] - offs[lo], data[offs[lo]:offs[hi]])
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(found.keys()), pa.string()),
                                                  "n": pa.array(list(found.values()), pa.int64())})
                lo = hi
    return (rows.mapInArrow(count, "word string, n long").filter(F.length("word") >= MIN_LENGTH)
                .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT))


def _keyed(words: DataFrame) -> DataFrame:
    """A row per word, role and interval: (k1, k2) digest what lies outside
    the interval, ``mid`` is what lies inside; q is the shorter word's part."""
    both = words.select("word", "n", F.length("word").alias("z")).withColumn(
        "a", F.explode(F.array("z", F.col("z") - 1))).withColumn(
        "w", F.greatest(F.lit(WIDTH), F.ceil((F.col("a") + 1) / INTERVALS).cast("int")))
    parts = both.withColumn("lo", F.explode(F.expr("sequence(0, a, w)"))).withColumn(
        "rest", F.greatest(F.lit(0), F.col("a") - F.col("lo") - F.col("w"))).withColumn(
        "q", F.col("a") - F.col("lo") - F.col("rest"))
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.col("z") - F.col("rest") + 1, F.col("rest"))
    return parts.select(F.xxhash64("a", "lo", head, tail).alias("k1"), F.xxhash64(F.lit(13), tail, head, "lo", "a").alias("k2"),
                        "word", "n", F.substring("word", F.col("lo") + 1, F.col("z") - F.col("lo") - F.col("rest")).alias("mid"),
                        "q", (F.col("lo") + F.col("w") > F.col("a")).alias("last"), (F.col("a") == F.col("z")).alias("short"))


def _near(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, q: np.ndarray, last: np.ndarray,
          sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Which pairs of two tiles are near. x, y: tiles of padded code points
    [item, word, position], rx, ry the same read backwards; q: the shorter
    word's length, last: whether the interval is its word's last [item];
    sx, sy: 1 shorter role, 0 longer, -1 padding [item, word]."""
    head = np.zeros((*x.shape[:2], y.shape[1]), np.int32 if x.shape[2] > 100 else np.int8)
    tail, run, back = head.copy(), np.ones(head.shape, bool), np.ones(head.shape, bool)
    for k in range(x.shape[2]):
        inside = (k < q)[:, None, None]
        run &= (x[:, :, None, k] == y[:, None, :, k]) & inside
        back &= (rx[:, :, None, k] == ry[:, None, :, k]) & inside
        head += run
        tail += back
    roles = np.where((sx[:, :, None] < 0) | (sy[:, None, :] < 0), 0, sx[:, :, None] + sy[:, None, :])
    q = q[:, None, None]
    # a first difference behind the interval is the next interval's
    return (roles > 0) & (head + tail >= q + (roles == 1) - 1) & ((head < q) | last[:, None, None])


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, near, best_n, best) of whole blocks that lie one behind another."""
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    head = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    at = np.flatnonzero(head)
    size = np.diff(np.concatenate((at, [len(pdf)])))
    some = np.repeat(size > 1, size)
    pdf = pdf[some].reset_index(drop=True)
    if not len(pdf):
        return pd.DataFrame({"word": [], "near": [], "best_n": [], "best": []}, dtype=object)
    size = size[size > 1]
    at = np.cumsum(size) - size
    word, n = pdf["word"].to_numpy(object), pdf["n"].to_numpy()
    q, last, short = pdf["q"].to_numpy(), pdf["last"].to_numpy(), pdf["short"].to_numpy().astype(np.int8)
    mids = pdf["mid"].to_numpy(object)
    rank = np.empty(len(pdf), np.int64)
    rank[sorted(range(len(pdf)), key=lambda i: (-n[i], word[i]))] = np.arange(len(pdf))
    near, best = np.zeros(len(pdf), np.int64), np.full(len(pdf), len(pdf), np.int64)
    tile = np.minimum(TILE, 2 ** np.ceil(np.log2(size)).astype(int))
    wide = 2 ** np.ceil(np.log2(q[at] + 1)).astype(int)
    for t, w in sorted({*zip(tile.tolist(), wide.tolist())}):
        items = []
        for b, s in zip(at[(tile == t) & (wide == w)].tolist(), size[(tile == t) & (wide == w)].tolist()):
            k = -(-s // t)
            items.extend((b + i * t, b + j * t, b + s) for i in range(k) for j in range(i, k))
        step = max(1, CELLS // (t * t * w))
        for lo in range(0, len(items), step):
            i, j, end = np.array(items[lo:lo + step]).T
            left, right = i[:, None] + np.arange(t), j[:, None] + np.arange(t)
            lin, rin = left < end[:, None], right < end[:, None]
            left, right = np.minimum(left, end[:, None] - 1), np.minimum(right, end[:, None] - 1)
            used, code = np.unique(np.concatenate((left.ravel(), right.ravel())), return_inverse=True)
            table = np.array([m for m in mids[used]], f"U{w}").view(np.uint32).reshape(len(used), w)
            turned = np.array([m[::-1] for m in mids[used]], f"U{w}").view(np.uint32).reshape(len(used), w)
            cl, cr = code[:left.size].reshape(left.shape), code[left.size:].reshape(right.shape)
            hit = _near(table[cl], table[cr], turned[cl], turned[cr], q[i], last[i],
                        np.where(lin, short[left], -1), np.where(rin, short[right], -1))
            g, x, y = np.nonzero(hit & (right[:, None, :] > left[:, :, None]))
            x, y = left[g, x], right[g, y]
            for u, v in ((x, y), (y, x)):
                near += np.bincount(u, minlength=len(near))
                np.minimum.at(best, u, rank[v])
    by_rank = np.argsort(rank)
    got = np.flatnonzero(near)
    top = by_rank[best[got]]
    return pd.DataFrame({"word": pd.Series(word[got], dtype=object), "near": near[got], "best_n": n[top],
                         "best": pd.Series(word[top], dtype=object)})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): per word of ``words`` (word, n) that has a
    near one, how many, and the most frequent of them (ties: the smallest)."""
    def compare(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            other = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1])) if len(pdf) else []
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield _blocks(pdf.iloc[:done].reset_index(drop=True))
            rest = pdf.iloc[done:]
        if rest is not None and len(rest):
            yield _blocks(rest.reset_index(drop=True))
    blocks = _keyed(words).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return (blocks.mapInPandas(compare, "word string, near long, best_n long, best string")
                  .groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b"))).alias("t"))
                  .select("word", "n_near", (-F.col("t.m")).alias("best_n"), F.col("t.b").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain. A form is at least
    ``RATIO`` times as frequent as its word, so there are no cycles and a
    handful of doublings reach every end."""
    step = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        step = moved.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per distinct word of all texts.

    A run is a maximal ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased. Where 97
    divides the crc32 of ``<doc_id>:<run>`` (UTF-8), the run loses its code
    point at crc32 modulo its length. Words have at least 5 code points and 3
    occurrences. Near words differ by exactly one inserted, deleted or replaced
    code point; a word's form is its most frequent near word (ties: the
    smallest in code-point order) if that is at least twice as frequent.

    Null and empty texts have no runs, a null id reads ``null``, repeated rows
    count each, runs of any length are words, an empty table gives no row;
    other columns are not read.
    """
    words = staged(word_counts(docs, doc_id, text), "spelling-words")
    near = near_words(words)
    known = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
