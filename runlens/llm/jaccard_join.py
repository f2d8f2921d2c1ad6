"""Operator 8: exact n-gram Jaccard self-join with a token-group matrix.

Similar documents are partitioned into groups; the matrix holds the tokens of
each group; the overlap of a query with a group's token union bounds its
overlap with every member, and only groups that meet the bound are opened.

The steps, each a Spark job over all documents:

1. One scan gives every document's set size and set digest (equal sets are one
   from here on) and the frequent tokens. All tokens get one global order,
   rare before frequent, then by hash.
2. Prefix filter: two sets with J >= t share one of the first
   n - ceil(t n) + 1 tokens of each in that order. One map-side combined
   aggregation finds the tokens that join different sets; the postings of
   these tokens are written.
3. Star rounds compare each set with a few pivots per token, so a group of
   any number of copies costs a number of comparisons in proportion to its
   rows. What it links are the similar documents of the partition; it is cut
   into groups of bounded size.
4. The matrix (token, group) is met with the tokens of the queries that lie in
   another component. A set that shares few of its tokens with others can only
   reach smaller sets, so sets meet by token and class of sizes, and those that
   reach nobody drop out before. The number of a query's tokens in a group's
   union bounds its overlap with every member; the groups that can qualify are
   opened and every member is compared. So no link between components is
   missed.

Only sets that such a bound leaves are read again and compared in full: of
the tokens up to the smaller of two last prefix tokens all shared ones are
counted, the rest is at most what one of the sets has behind its prefix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import Bitmap, components, mix, pieces, release_shuffles, shingles, staged, used_up, words

NUM, DEN = 80, 100            # link when DEN * intersection >= NUM * union
FREQUENT = 4_000_000          # at most so many tokens (9 bytes each in a task) are held to be frequent: count >= all tokens / FREQUENT
GROUP = 256                   # sets in a group, about
STAR_ROUNDS = 1
PIVOTS = 6                    # per token and round
BATCH_ROWS = 1000             # rows handed to a task's Python at a time
PIECE = 1 << 20               # code points hashed at a time in a task (or one text)
COUNTED = 1 << 21             # tokens counted at a time in a task (or those of a piece)
PRUNE = 2                     # rounds that drop sets without reach
EXACT, STEP = 48, 1.02        # sizes from EXACT on form classes, each STEP times as wide as the one before
BLOCK = 8                     # classes of sizes in a block
UNION = 4096                  # tokens of a group's union in a row, about


def _prefix(n, num: int, den: int):
    """Length of the prefix of a set of ``n`` tokens (array)."""
    return n - -(-n * num // den) + 1


def _behind(n, num: int, den: int):
    """Tokens behind the prefix (column)."""
    return F.ceil(n * num / F.lit(den)) - 1


class _Frequent:
    """Order of tokens: 6 bits of frequency class, then 57 bits of hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.t = tokens[at]
        self.cls = np.floor(np.log2(np.maximum(counts[at], 1))).astype(np.uint8) + np.uint8(1)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.t >> np.uint64(44)] = True

    def keys(self, tok: np.ndarray) -> np.ndarray:
        cls = np.zeros(len(tok), np.uint64)
        if len(self.t):
            maybe = np.flatnonzero(self.table[tok >> np.uint64(44)])
            i = np.searchsorted(self.t, tok[maybe]).clip(0, len(self.t) - 1)
            hit = self.t[i] == tok[maybe]
            cls[maybe[hit]] = self.cls[i[hit]]
        return (cls << np.uint64(57)) | (tok >> np.uint64(7))


def _sort_each(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sort each of the consecutive runs of lengths ``n``."""
    hi = 0
    for c in n.tolist():
        lo, hi = hi, hi + c
        s[lo:hi].sort()
    return s


def _sets(texts: list):
    """(set index, sorted distinct tokens of all sets, their number per set)."""
    h, n = words(texts)
    s, m = shingles(h, n)
    who = np.repeat(np.arange(len(texts)), m)
    s = _sort_each(s >> np.uint64(1), m)  # positive as bigint
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    s, who = s[first], who[first]
    return s, np.bincount(who, minlength=len(texts))


def _digests(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set that its order does not change."""
    at = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(s + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)


def _repeated(tokens: list[np.ndarray]) -> pd.DataFrame:
    every = np.concatenate(tokens)
    every.sort()
    tok, c = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
    return pd.DataFrame({"kind": 1, "id": pd.array([None] * len(tok), dtype="Int64"), "n": c + 1, "v": tok.view(np.int64)})


def _scan(rows: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, digest); kind 1: tokens met more than once among so
    many, with their count."""
    def scan(batches):
        seen, held = [], 0
        for pdf in batches:
            for part in pieces(pdf, PIECE):
                s, n = _sets(part["x"].tolist())
                yield pd.DataFrame({"kind": 0, "id": part["d"].astype("Int64"), "n": n, "v": _digests(s, n)})
                seen.append(s)
                held += len(s)
                if held >= COUNTED:
                    yield _repeated(seen)
                    seen, held = [], 0
        if seen:
            yield _repeated(seen)
    return rows.mapInPandas(scan, "kind int, id long, n long, v long")


def _emit_prefixes(rows: DataFrame, order: _Frequent, num: int, den: int) -> DataFrame:
    def emit(batches):
        for pdf in batches:
            for part in pieces(pdf, PIECE):
                s, n = _sets(part["x"].tolist())
                sid = _digests(s, n)
                k = _sort_each(order.keys(s), n)
                pos = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                # equal sets of a chunk give their tokens once
                keep = (pos < np.repeat(_prefix(n, num, den), n)) & np.repeat(~pd.Series(sid).duplicated().to_numpy(), n)
                yield pd.DataFrame({"token": k[keep].view(np.int64), "sid": np.repeat(sid, n)[keep]})
    return rows.mapInPandas(emit, "token long, sid long")


def _postings(rows: DataFrame, order: _Frequent, shared: Bitmap, num: int, den: int) -> DataFrame:
    """(token, sid, n, pos, last): the prefix tokens that the bitmap holds;
    last is the set's last prefix token."""
    def emit(batches):
        for pdf in batches:
            for part in pieces(pdf, PIECE):
                s, n = _sets(part["x"].tolist())
                sid = _digests(s, n)
                k = _sort_each(order.keys(s), n)
                start, query = np.cumsum(n) - n, _prefix(n, num, den)
                last = k[(start + query - 1).clip(0, max(len(k) - 1, 0))] if len(k) else np.zeros(len(n), np.uint64)
                pos = np.arange(len(k)) - np.repeat(start, n)
                keep = (pos < np.repeat(query, n)) & np.repeat(~pd.Series(sid).duplicated().to_numpy(), n)
                keep[keep] = shared.holds(k[keep])
                yield pd.DataFrame({"token": k[keep].view(np.int64), "sid": np.repeat(sid, n)[keep],
                                    "n": np.repeat(n, n)[keep].astype(np.int32), "pos": pos[keep].astype(np.int32),
                                    "last": np.repeat(last, n)[keep].view(np.int64)})
    return rows.mapInPandas(emit, "token long, sid long, n int, pos int, last long")


def _wanted_sets(rows: DataFrame, order: _Frequent, sids: DataFrame) -> DataFrame:
    """(sid, toks) for the digests in ``sids`` (and a few more that share
    their bits), once a task; toks are the sorted tokens."""
    wanted = Bitmap(sids, "sid")

    def emit(batches):
        done: set = set()
        for pdf in batches:
            for part in pieces(pdf, PIECE):
                s, n = _sets(part["x"].tolist())
                sid = _digests(s, n)
                ends = np.cumsum(n)
                out = []
                for i in np.flatnonzero(wanted.holds(sid.view(np.uint64)) & (n > 0)).tolist():
                    if int(sid[i]) not in done:
                        done.add(int(sid[i]))
                        out.append((int(sid[i]), s[ends[i] - n[i]:ends[i]].tobytes()))
                yield pd.DataFrame(out, columns=["sid", "toks"])
    return staged(rows.mapInPandas(emit, "sid long, toks binary"), "jaccard-sets")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    inter = int(np.count_nonzero(b[i] == a))
    return den * inter >= num * (len(a) + len(b) - inter)


def _verify_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set digests that link."""
    left = sets.select(F.col("sid").alias("a"), F.col("toks").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("toks").alias("tb"))

    def check(batches):
        for pdf in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(pdf["ta"], pdf["tb"])]
            yield pdf.loc[ok, ["a", "b"]]
    return pairs.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long")


def _bounded_pairs(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, n, last, b, nb, lb) those whose counted prefix overlap
    leaves them a chance, as (a, b) with a > b. ``prefixes``: (sid, toks), the
    shared prefix tokens of each set in one row, so that a pair is one row too."""
    one, two = prefixes.select(F.col("sid").alias("a"), F.col("toks").alias("ta")), prefixes.select(F.col("sid").alias("b"), F.col("toks").alias("tb"))
    rest = F.when(F.col("last") <= F.col("lb"), _behind(F.col("n"), num, den)).otherwise(_behind(F.col("nb"), num, den))
    return (pairs.join(one, "a").join(two, "b").withColumn("c", F.size(F.array_intersect("ta", "tb")))
                 .filter((den + num) * (F.col("c") + rest) >= num * (F.col("n") + F.col("nb")))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _linked_pairs(rows: DataFrame, order: _Frequent, pairs: DataFrame, name: str, num: int, den: int) -> DataFrame:
    """Read the sets of the pairs and keep the pairs that link."""
    pairs = staged(pairs, f"jaccard-pairs-{name}")
    sets = _wanted_sets(rows, order, pairs.select(F.explode(F.array("a", "b")).alias("sid")))
    links = staged(_verify_pairs(pairs, sets, num, den), f"jaccard-links-{name}")
    used_up(pairs, sets)
    release_shuffles(rows.sparkSession)
    return links


def _size_class(n):
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(F.log(n / float(EXACT)) / float(np.log(STEP)))).cast("int")


def _within_reach(p: DataFrame, num: int, den: int) -> DataFrame:
    """Of the postings those that can still link something, with ``reach``: a
    set that shares c prefix tokens with other components overlaps another set
    by c and what is behind its prefix at most, and so by too little if that
    set is larger than ``reach``."""
    for _ in range(PRUNE):
        mixed = p.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token")
        before, p = p, staged(p.drop("reach").join(mixed, "token"), "jaccard-mixed")
        used_up(before)
        reach = F.floor((den + num) * (F.count(F.lit(1)) + _behind(F.col("n"), num, den)) / F.lit(num)) - F.col("n")
        sets = (p.groupBy("sid", "n").agg(reach.alias("reach")).filter(F.col("reach") >= F.ceil(F.col("n") * num / F.lit(den)))
                 .select("sid", "reach"))
        reached = p.join(sets, "sid")
        met = reached.groupBy("token").agg(F.min("n").alias("n0"), F.max("reach").alias("r1"))
        before, p = p, staged(reached.join(met, "token").filter("n0 <= reach AND n <= r1").drop("n0", "r1"), "jaccard-reach")
        used_up(before)
        release_shuffles(p.sparkSession)
    return p


def _bounded_queries(met: DataFrame, p: DataFrame, matrix: DataFrame, least, num: int, den: int) -> DataFrame:
    """Of the queries and groups (q, n, gid, n0, n1) those whose counted overlap
    leaves them a chance, as (q, gid). A query's tokens are one row and a group's
    a row per UNION of them, so no row per token is made of what meets."""
    asked = p.groupBy(F.col("sid").alias("q")).agg(F.collect_list("token").alias("tq"))
    parts = matrix.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / F.lit(UNION)).alias("parts"))
    unions = (matrix.select("gid", "token").join(parts, "gid")
                    .groupBy("gid", F.pmod(F.xxhash64("token"), F.col("parts")).alias("part")).agg(F.collect_list("token").alias("tg")))
    behind = F.greatest(_behind(F.col("n"), num, den), _behind(F.col("n1"), num, den))
    return (met.join(asked, "q").join(unions, "gid").groupBy("q", "n", "gid", "n0", "n1").agg(F.sum(F.size(F.array_intersect("tq", "tg"))).alias("c"))
               .filter((den + num) * (F.col("c") + behind) >= num * (F.col("n") + least)).select("q", "gid"))


def set_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM,
              den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(docs, links): (doc_id, n, sid) per row, and enough links (a, b)
    between different sets to connect whatever any link connects."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_ROWS))   # every step that runs Python is written in here
    try:
        return _set_links(docs, doc_id, text, num, den)
    finally:
        conf.set(key, before)


def _set_links(docs: DataFrame, doc_id: str, text: str, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("x"))
    scan = staged(_scan(rows), "jaccard-scan")
    own = scan.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n"), F.col("v").alias("sid"))
    total = own.agg(F.sum("n")).first()[0] or 0
    often = (scan.filter("kind = 1").groupBy(F.col("v").alias("token")).agg(F.sum("n").alias("c"))
                 .filter(F.col("c") >= max(3, total // FREQUENT))).toArrow()
    # By the threshold there are FREQUENT of them at most, whatever the input.
    order = _Frequent(often["token"].to_numpy().view(np.uint64), often["c"].to_numpy())
    shared = staged(_emit_prefixes(rows, order, num, den).groupBy("token")
                    .agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
                    .filter("lo <> hi").select("token"), "jaccard-tokens")
    posts = staged(_postings(rows, order, Bitmap(shared, "token"), num, den)
                   .join(shared, "token").dropDuplicates(["token", "sid"]), "jaccard-postings")
    used_up(shared)
    release_shuffles(docs.sparkSession)
    prefixes = staged(posts.groupBy("sid").agg(F.collect_list("token").alias("toks")), "jaccard-prefixes")
    release_shuffles(docs.sparkSession)

    # Star rounds: every set against pivots of its tokens that lie in another
    # component by then. A set that no pivot reaches waits for the matrix.
    links, p = None, posts.withColumn("comp", F.col("sid"))
    for r in range(STAR_ROUNDS):
        # Half of them are the sets that have the fewest rarer tokens: what a
        # group of edited copies has in common, and so linked to most of it.
        pivot = [F.min(F.struct((F.col("pos") if k % 2 else F.lit(0)).alias("o"), F.xxhash64("sid", F.lit(r * PIVOTS + k)).alias("h"),
                                F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"), F.col("comp").alias("cb"),
                                F.col("pos").alias("pb"))) for k in range(PIVOTS)]
        pivots = (p.groupBy("token").agg(F.array(*pivot).alias("v"),
                                         F.min("comp").alias("c0"), F.max("comp").alias("c1"))
                   .filter("c0 <> c1").select("token", F.explode("v").alias("v")).select("token", "v.b", "v.nb", "v.lb", "v.cb", "v.pb").distinct())
        stars = (p.join(pivots, "token")
                  .filter((F.col("comp") != F.col("cb")) & (den * F.least("n", "nb") >= num * F.greatest("n", "nb"))
                          & ((den + num) * F.least(F.col("n") - F.col("pos"), F.col("nb") - F.col("pb")) >= num * (F.col("n") + F.col("nb"))))
                  .select(F.col("sid").alias("a"), "n", "last", "b", "nb", "lb").distinct())
        found = _linked_pairs(rows, order, _bounded_pairs(stars, prefixes, num, den), "star", num, den)
        links = found if links is None else links.unionAll(found)
        roots = components(links)
        p = staged(posts.join(roots, F.col("sid") == F.col("node"), "left")
                        .withColumn("comp", F.coalesce("root", "sid")).drop("node", "root"), "jaccard-placed")
        used_up(roots)
        release_shuffles(docs.sparkSession)

    p = _within_reach(p, num, den)
    # What the stars link is similar: cut into groups of one class of sizes.
    sizes = p.select("sid", "comp", "n", "reach").distinct().withColumn("sb", _size_class(F.col("n")))
    chunks = sizes.groupBy("comp").agg(F.count(F.lit(1)).alias("k"))
    groups = staged(sizes.join(chunks, "comp").select("sid", "comp", "n", "reach", "sb", F.xxhash64(
        "comp", "sb", F.pmod(F.xxhash64("sid", F.lit(9)), F.ceil(F.col("k") * 2 / GROUP))).alias("gid")), "jaccard-groups")
    # The matrix: the tokens of each group's union, with the bounds of its sizes.
    shape = groups.groupBy("gid", "sb").agg(F.max("comp").alias("gcomp"), F.min("n").alias("n0"), F.max("n").alias("n1"),
                                            F.max("reach").alias("greach"))
    grouped, groups = groups, groups.select("sid", "gid")
    matrix = staged(p.join(groups, "sid").groupBy("token", "gid").agg(F.max(F.col("n") - F.col("pos")).alias("rest"))
                     .join(shape, "gid"), "jaccard-matrix")
    release_shuffles(docs.sparkSession)
    # The larger of two sets asks for the smaller one's class, as far as its
    # reach goes; blocks of classes meet, so that a query is in few of them. A
    # query and a member that link have a first token in common, and from there on
    # enough left on both sides.
    small = F.ceil(F.col("n") * num / F.lit(den))
    least = F.greatest(F.col("n0"), small)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    asks = (p.withColumn("own", _size_class(F.col("n"))).withColumn("lo", _size_class(small)).withColumn("hi", _size_class(F.least("n", "reach")))
             .withColumn("block", F.explode(F.sequence(block("lo"), block("hi")))))
    met = (asks.join(matrix.withColumn("block", block("sb")), ["token", "block"])
            .filter((F.col("sb") >= F.col("lo")) & (F.col("sb") <= F.col("hi")))
            .filter((F.col("comp") != F.col("gcomp")) & ((F.col("sb") < F.col("own")) | (F.col("comp") < F.col("gcomp")))
                    & (num * F.col("n") <= den * F.col("n1")) & (F.col("n0") <= F.col("reach")) & (F.col("n") <= F.col("greach"))
                    & ((den + num) * F.least(F.col("n") - F.col("pos"), F.col("rest")) >= num * (F.col("n") + least)))
            .select(F.col("sid").alias("q"), "n", "gid", "n0", "n1").distinct())
    cand = staged(_bounded_queries(met, p, matrix, least, num, den), "jaccard-queries")
    release_shuffles(docs.sparkSession)
    # Open the groups that are left.
    own_n = p.select("sid", "n", "last").distinct()
    opened = (cand.join(groups, "gid").select(F.col("q").alias("a"), F.col("sid").alias("b"))
                  .join(own_n.select(F.col("sid").alias("a"), "n", "last"), "a")
                  .join(own_n.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb")), "b")
                  .filter(den * F.least("n", "nb") >= num * F.greatest("n", "nb")))
    links = links.unionAll(_linked_pairs(rows, order, _bounded_pairs(opened, prefixes, num, den), "matrix", num, den))
    used_up(posts, prefixes, p, matrix, cand, grouped)
    return own, links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM,
                       den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the distinct 5-word shingles
    of the whole text, and the smallest doc_id that links reach.

    Two rows link when ``den * |A & B| >= num * |A | B|``. Rows with equal
    sets link; null, empty and wordless texts have empty sets, link with
    nothing and are their own component; a text of 1 to 4 words is one
    shingle. A null id counts as the largest: its component is the smallest
    id linked to it, null if there is none. Other columns are not read.
    """
    own, links = set_links(docs, doc_id, text, num, den)
    root = components(links)
    per = own.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    rooted = per.join(root, F.col("sid") == F.col("node"), "left").select(
        "sid", "first", F.coalesce("root", "sid").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("first").alias("component"))
    by_set = staged(rooted.join(tops, "root").select(F.col("sid").alias("s"), "component"), "jaccard-components")
    key = F.when(F.col("n") > 0, F.col("sid"))
    return (own.withColumn("k", key).join(by_set, F.col("k") == F.col("s"), "left")
               .select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))
