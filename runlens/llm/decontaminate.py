"""Operator 2: benchmark decontamination by the q-gram lemma.

An item that occurs in a text with at most ``e`` edits shares with it at
least ``m - q + 1 - q*e`` of its q-grams, on diagonals at most ``e`` apart.
Shared q-grams are counted in overlapping bands of diagonals; bands that
meet the bound are verified by banded alignment. Items too short for that are
matched as they are, between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import mix

Q = 10              # characters of a gram
EDIT_RATE = 0.08    # edits per character of an item
MIN_CHARS = 24      # shorter items (normalised) are matched without edits
BLOCK_CHARS = 4_000_000  # characters of benchmark that one pass over the texts looks for
PIECE_CHARS = 1 << 20    # characters of text handled at a time in a task
CELLS = 1 << 22          # characters of regions aligned at a time in a task

_G = np.uint64(0x100000001B3)
_TABLE_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: the hash of 2k characters from two hashes of k
    h, k, x = c.astype(np.uint64) + np.uint64(1), 1, None
    p = np.array([_G])
    at, done = np.zeros(n, np.uint64), 0
    bits = q
    while bits:
        if bits & 1:
            at = at * p + h[done:done + n]
            done += k
        bits >>= 1
        if bits:
            h = h[:-k] * p + h[k:]
            p = p * p
            k *= 2
    return mix(at)


class Index:
    """The q-grams of a block of items: sorted hashes with (item, offset)."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, min_chars: int):
        self.q, self.ids, self.text, self.edits, self.bound = q, [], [], [], []
        hs, who, off = [], [], []
        short: dict[str, list[int]] = {}
        for i, t in items:
            c = codes(normal(t))
            if len(c) < max(min_chars, q):
                if len(c):
                    short.setdefault(normal(t), []).append(i)
                continue
            e = min(int(rate * len(c)), (len(c) - q) // q)  # the lemma's bound stays at 1 at least
            k = len(self.ids)
            self.ids.append(i)
            self.text.append(c)
            self.edits.append(e)
            self.bound.append(len(c) - q + 1 - q * e)
            g = grams(c, q)
            hs.append(g)
            who.append(np.full(len(g), k))
            off.append(np.arange(len(g)))
        self.short = ahocorasick.Automaton() if short else None
        for t, own in short.items():
            self.short.add_word(t, (len(t), own))
        if short:
            self.short.make_automaton()
        self.h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        order = np.argsort(self.h, kind="stable")
        self.h = self.h[order]
        self.who = np.concatenate(who)[order] if hs else np.empty(0, np.int64)
        self.off = np.concatenate(off)[order] if hs else np.empty(0, np.int64)
        self.width = max(self.edits, default=0) + 1
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.h >> np.uint64(64 - _TABLE_BITS)] = True
        self.bound = np.array(self.bound, dtype=np.int64)
        self.edits = np.array(self.edits, dtype=np.int64)
        self.len = np.array([len(c) for c in self.text], dtype=np.int64)

    def regions(self, c: np.ndarray) -> np.ndarray:
        """(item, first diagonal) of the bands of ``c`` that meet the bound."""
        g = grams(c, self.q)
        pos = np.flatnonzero(self.table[g >> np.uint64(64 - _TABLE_BITS)])
        if not len(pos):
            return np.empty((0, 2), np.int64)
        lo = np.searchsorted(self.h, g[pos], side="left")
        n = np.searchsorted(self.h, g[pos], side="right") - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        if n.sum() < self.bound.min():
            return np.empty((0, 2), np.int64)
        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item, diag = self.who[at], np.repeat(pos, n) - self.off[at] + int(self.len.max())
        band = diag // self.width
        # each band is two widths wide and shares one with the next: diagonals
        # at most a width apart lie in one band together
        top = int(band.max()) + 2
        key = np.concatenate((item * top + band + 1, item * top + band))
        key, count = np.unique(key, return_counts=True)
        ok = count >= self.bound[key // top]
        return np.stack((key[ok] // top, (key[ok] % top - 1) * self.width - int(self.len.max())), axis=1)

    def verify(self, c: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, end, region) of the regions in which the item aligns
        within its budget; all regions of a text are aligned together."""
        if not len(found):
            return []
        k, first = found[:, 0], found[:, 1]
        m, e = self.len[k], self.edits[k]
        wide = 2 * self.width + 2 * int(e.max()) + 1
        long = int(m.max())
        item = np.zeros((len(k), long), np.uint32)
        for r, x in enumerate(k):
            item[r, :self.len[x]] = self.text[x]
        start = first - e
        cols = start[:, None] + np.arange(long + wide)
        inside = (cols >= 0) & (cols < len(c))
        win = np.where(inside, c[cols.clip(0, len(c) - 1)], np.uint32(0xFFFFFFFF))
        ramp = np.arange(wide)
        row = np.zeros((len(k), wide), np.int64)
        best = np.full(len(k), 1 << 30)
        end = np.zeros(len(k), np.int64)
        for i in range(1, long + 1):
            new = row + (win[:, i - 1:i - 1 + wide] != item[:, i - 1:i])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
            row = new
            for r in np.flatnonzero(m == i):
                j = int(row[r].argmin())
                best[r], end[r] = row[r, j], start[r] + i + j
        ok = best <= e
        return [(int(a), int(b), int(x), int(f)) for a, b, x, f in zip(k[ok], best[ok], end[ok], first[ok])]

    def exact(self, text: str | None) -> dict[int | None, int]:
        """item id -> end of the first place in the text where a short item
        stands between word borders."""
        out: dict = {}
        if self.short is None or not text:
            return out
        t = normal(text)
        for last, (n, own) in self.short.iter(t):
            at = last + 1 - n
            if not (at and t[at - 1].isalnum() and t[at].isalnum()) and not (last + 1 < len(t) and t[last].isalnum() and t[last + 1].isalnum()):
                for i in own:
                    out.setdefault(i, last + 1)
        return out

    def search(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item index -> (fewest edits, end of the first such place) in the
        whole text; long texts in pieces that overlap by more than an item."""
        out: dict[int, tuple[int, int]] = {}
        if not len(self.h) or not text:
            return out
        c = codes(normal(text))
        over = int(self.len.max()) + 4 * self.width + self.q
        for lo in range(0, max(len(c) - over, 1), PIECE_CHARS):
            piece = c[lo:lo + PIECE_CHARS + over]
            found = self.regions(piece)
            step = max(1, CELLS // over)
            for k in range(0, len(found), step):
                for i, edits, end, _ in self.verify(piece, found[k:k + step]):
                    out[i] = min(out.get(i, (1 << 30, 0)), (edits, lo + end))
        return out


def _benchmark_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int):
    """The items (id, text), a list at a time, of ``block_chars`` at most (plus one item)."""
    bench = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    chars = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for b in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else bench
        yield sorted(((r.i, r.t) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  q: int = Q, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item (as ``find_contamination`` finds
    them). Every row is judged by its own text, whatever its id."""
    for items in _benchmark_blocks(benchmark, item_id, item_text, block_chars):
        docs = docs.filter(_clean(items, q, rate, min_chars)(F.col(text)))
    return docs


def _clean(items: list, q: int, rate: float, min_chars: int):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items, q, rate, min_chars)
        for texts in batches:
            yield pd.Series([not (index.search(x) or index.exact(x)) for x in texts], dtype=bool)
    return clean


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE,
                       min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, end_char): each item that occurs, normalised,
    in a text with at most ``rate`` edits per character, with the fewest edits
    and the place where it then ends in the normalised text.

    The benchmark is sent to the tasks in blocks of ``block_chars`` at most
    (plus one item); each block is one pass over all texts. Null and empty
    texts match nothing; items shorter than ``min_chars`` match without edits,
    where no letter or digit goes on before or after them. Repeated rows
    give repeated results; a null id stays null. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("x"))
    schema = "doc_id long, item_id long, edits int, end_char long"
    out = None
    for items in _benchmark_blocks(benchmark, item_id, item_text, block_chars):
        def search(batches, items=items):
            index = Index(items, q, rate, min_chars)
            for pdf in batches:
                got = [(d, index.ids[i], edits, end) for d, x in zip(pdf["d"], pdf["x"])
                       for i, (edits, end) in sorted(index.search(x).items())]
                got += [(d, i, 0, end) for d, x in zip(pdf["d"], pdf["x"]) for i, end in index.exact(x).items()]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "edits", "end_char"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64"})

        one = rows.mapInPandas(search, schema)
        out = one if out is None else out.unionAll(one)
    return out
