"""Operator 6: bulk-synchronous best-fit packing.

Texts become token ids; documents longer than a sequence are cut. What is
left is packed in supersteps: documents and the gaps of open sequences are
sorted by size and dealt out by range of size; each range sweeps its
documents from the largest down, every one taking the smallest gap that
holds it (larger ones first where several want the same); the gaps are
updated, documents that found none go on to the next range of larger gaps.
When all have been everywhere, new sequences are opened for the largest of
the rest, and so on until nothing is left.

Only sizes matter to the match, so documents of one length, and gaps of one
size, travel as runs (first number, count): a length that a third of all
documents have is one row.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.sharding import with_slots

CAPACITY = 2048
RANGES = 2              # of gap sizes, swept apart in a superstep
OPEN_SHARE = 95         # per cent of the sequences that the ids left need at least, opened at a time
CACHE_WORDS = 600_000   # words whose ids a task keeps
END = 0                 # id that ends a document
BROADCAST_RUNS = 200_000  # placed runs up to which they are sent to every task

_PUNCTUATED = regex.compile(r"(\p{L}+)([.,!?:;|*#$%&]+)")
_STATE = "kind int, size int, first long, n long, k int, bin long, at int, band int"


class Encoder:
    """Ids of a text under a word-level byte pair encoding that drops white
    space: words between ASCII white space are encoded apart, and a worker
    keeps the ids of the words it has seen."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_packing_word_cache", types.ModuleType("_packing_word_cache"))
        if getattr(kept, "definition", None) != definition:
            kept.definition, kept.words = definition, {}
            kept.tokenizer = Tokenizer.from_str(definition)
            kept.ends = np.zeros(kept.tokenizer.get_vocab_size(), dtype=bool)
            kept.ends[[i for w, i in kept.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.t, self.words, self.ends = kept.tokenizer, kept.words, kept.ends

    def _whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[bytes]) -> None:
        known = self.words
        if len(known) + 2 * len(missing) > CACHE_WORDS:
            known.clear()
        plain, parts = set(), []
        for w in missing:
            s = w.decode("utf-8", "surrogatepass")
            if s.isalpha():
                plain.add(w)
            elif (m := _PUNCTUATED.fullmatch(s)) and m[1].isalpha():
                base, tail = m[1].encode(), m[2].encode()
                parts.append((w, base, tail))
                if base not in known:
                    plain.add(base)
                if tail not in known:
                    known[tail] = self._whole(m[2])
            else:
                known[w] = self._whole(s)
        # Words of letters only are one token run each, closed by an end mark,
        # so many can be encoded in one text and told apart again.
        todo = list(plain)
        for lo in range(0, len(todo), 512):
            some = todo[lo:lo + 512]
            got = np.array(self.t.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[got]) + 1
            if len(cut) == len(some) and cut[-1] == len(got):
                raw, at = got.tobytes(), 0
                for w, end in zip(some, (4 * cut).tolist()):
                    known[w] = raw[at:end]
                    at = end
            else:
                for w in some:
                    known[w] = self._whole(w.decode())
        for w, base, tail in parts:
            known[w] = known[base] + known[tail]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        raw = text.encode("utf-8", "surrogatepass")
        if b"<|" in raw:  # special tokens are looked for before lower-casing
            return self._whole(text)
        words = raw.lower().split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            # a text with more new words than the cache holds is encoded in parts
            for lo in range(0, len(words), CACHE_WORDS // 4):
                if missing := [w for w in set(words[lo:lo + CACHE_WORDS // 4]) if w not in self.words]:
                    self._learn(missing)
            got = self.words.get
            return b"".join([v if (v := got(w)) is not None else self._whole(w.decode("utf-8", "surrogatepass")) for w in words])


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text
    and the end id, cut after every ``capacity`` ids. ``tokenizer`` is the
    path of its definition, which the driver reads and sends along."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    closing = np.array([END], dtype="<u4").tobytes()

    def cut(batches):
        enc = Encoder(definition)
        for pdf in batches:
            out = []
            for d, x in zip(pdf["d"], pdf["x"]):
                ids = enc.encode(x) + closing
                for p in range(0, len(ids), 4 * capacity):
                    part = ids[p:p + 4 * capacity]
                    out.append((d, p // (4 * capacity), p // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        enc.words.clear()  # a worker that goes on to other tasks gives the memory back

    return (docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("x"))
                .mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def _sweep(docs: list, gaps: list, capacity: int) -> tuple[list, list, list]:
    """One range: (left docs, gaps after, placed). docs: (size, first, n) by
    falling size; gaps: (size, first bin, n). Documents of one length fill the
    smallest gap that holds them, as many in each as fit."""
    open_: dict[int, list] = {}
    for g, b, n in gaps:
        open_.setdefault(g, []).append((b, n))
    placed, left = [], []
    for size, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        for g in sorted(x for x in open_ if x >= size):
            runs = open_.pop(g)
            while n and runs:
                b, bins = runs.pop()
                k = g // size
                use = min(bins, max(1, n // k))
                take = min(n, k) if use == 1 else k
                placed.append((size, first, use * take, take, b, capacity - g))
                first, n = first + use * take, n - use * take
                open_.setdefault(g - take * size, []).append((b, use))
                if bins > use:
                    runs.append((b + use, bins - use))
            if runs:
                open_.setdefault(g, []).extend(runs)
            if not n:
                break
        if n:
            left.append((size, first, n))
    return left, [(g, b, n) for g, runs in open_.items() if g for b, n in runs], placed


def _superstep(state: DataFrame, capacity: int) -> DataFrame:
    """kind 0: runs of documents, kind 1: runs of gaps, kind 2: what was
    placed. Every range of sizes sweeps on its own; documents beyond the last
    range wait for new sequences."""
    width = -(-capacity // RANGES)

    def run(key, pdf):
        docs = list(pdf.loc[pdf["kind"] == 0, ["size", "first", "n"]].itertuples(index=False, name=None))
        gaps = list(pdf.loc[pdf["kind"] == 1, ["size", "bin", "n"]].itertuples(index=False, name=None))
        left, after, placed = _sweep(docs, gaps, capacity)
        rows = ([(0, s, f, n, 0, 0, 0, int(key[0]) + 1) for s, f, n in left]
                + [(1, g, 0, n, 0, b, 0, g // width) for g, b, n in after]
                + [(2, s, f, n, k, b, at, 0) for s, f, n, k, b, at in placed])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])

    swept = state.filter(f"kind < 2 AND band < {RANGES}").groupBy("band").applyInPandas(run, _STATE)
    return swept.unionAll(state.filter(f"kind = 0 AND band >= {RANGES}"))


def open_sequences(rest: list, capacity: int) -> tuple[list, list]:
    """(runs that open a sequence each, runs left): the largest of the rest,
    one for each that can share with no equal, and OPEN_SHARE of what the ids
    left ask for at least."""
    want = max(sum(n for s, _, n in rest if 2 * s > capacity),
               -(-sum(s * n for s, _, n in rest) * OPEN_SHARE // (100 * capacity)))
    opened, left = [], []
    for s, f, n in sorted(rest, key=lambda d: (-d[0], d[1])):
        take = min(n, want)
        want -= take
        if take:
            opened.append((s, f, take))
        if n > take:
            left.append((s, f + take, n - take))
    return opened, left


def best_fit(lengths: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(placed runs, sequences used) for ``lengths`` (length, n), all below
    ``capacity``: rows (size, first, n, k, bin, at) say that documents first
    to first + n - 1 of a length go k to a sequence from ``bin`` on, behind
    ``at`` ids."""
    spark = lengths.sparkSession
    width = -(-capacity // RANGES)
    # One run per length at first: bounded by the capacity, whatever the input.
    rest = [(int(r.length), 0, int(r.n)) for r in lengths.collect()]
    gaps: list = []
    bins, done = 0, spark.createDataFrame([], _STATE)
    while rest:
        opened, docs = open_sequences(rest, capacity)
        first = []
        for s, f, n in opened:
            first.append((2, s, f, n, 1, bins, 0, 0))
            gaps.append((capacity - s, bins, n))
            bins += n
        done = done.unionAll(spark.createDataFrame(first, _STATE))
        if not docs:
            break
        state = spark.createDataFrame([(0, s, f, n, 0, 0, 0, s // width) for s, f, n in docs]
                                      + [(1, g, 0, n, 0, b, 0, g // width) for g, b, n in gaps], _STATE)
        for _ in range(RANGES):
            state = staged(_superstep(state, capacity), "pack-step")
            done = done.unionAll(state.filter("kind = 2"))
        after = state.filter("kind < 2").collect()
        rest = [(r.size, r.first, r.n) for r in after if r.kind == 0]
        gaps = [(r.size, r.bin, r.n) for r in after if r.kind == 1]
    return done.drop("kind", "band"), bins


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every
    piece of every document, in sequences of ``capacity`` ids at most.

    A document longer than a sequence is cut into full pieces and a last one;
    nothing else is cut. A null or empty text is the end id alone. Repeated
    rows, equal texts and equal ids are documents of their own; null ids stay
    null. Sequence numbers are negative where a full piece is alone.
    """
    pieces = token_pieces(docs, tokenizer, doc_id, text, capacity)
    sized = pieces.withColumn("shard", F.when(F.col("length") < capacity, F.col("length")).otherwise(0))
    ranked = staged(with_slots(sized, "pieces"), "piece-ranks")
    lengths = ranked.filter("shard > 0").groupBy(F.col("shard").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    runs, _ = best_fit(lengths, capacity)
    runs = staged(runs, "runs")
    side = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = ranked.filter("shard = 0").select(*own, (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    j = F.col("slot") - F.col("first")
    shared = (ranked.filter("shard > 0").join(side, (F.col("shard") == F.col("size")) & (F.col("slot") >= F.col("first"))
                                              & (F.col("slot") < F.col("first") + F.col("n")))
                    .select(*own, (F.col("bin") + F.floor(j / F.col("k"))).cast("bigint").alias("sequence_id"),
                            (F.col("at") + j % F.col("k") * F.col("size")).cast("bigint").alias("offset")))
    return alone.unionAll(shared)
