"""Operator 12: main text of web pages by minimum-cut labelling.

A page is cut into blocks (the text between block-level tags). A classifier
says what it would cost to call each block content or boilerplate; these costs
are the capacities to the two terminals. Blocks that follow each other, and
blocks and the elements that hold them, are joined by smoothness edges. The
minimum cut is the cheapest labelling, and a maximum flow finds it.

The classifier adds two parts. The rules below read what a page says about
itself (semantic elements, roles, names of classes). The other part is learned
here, from all pages: log-odds of the shape of a block (length, share of links,
sentence end, kind of element), counted over the blocks that the rules are sure
of; it decides where a page says nothing. Its counts are one map-side combined
aggregation over all pages, with a row per feature; pages are labelled in a
second scan, each on its own, so nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("applet audio button canvas datalist iframe map math noembed noframes noscript object select svg template video".split())
#: So is theirs, and it is read up to their own end tag, whatever is in between.
RAW = frozenset("script style textarea title xmp".split())
#: An open element of the first kind ends where one of the others begins.
CLOSES = {"p": frozenset("""address article aside blockquote center details dialog div dl dd dt fieldset figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr li main menu nav ol p pre search section table td th tr ul""".split()),
          "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"},
          "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("aside dialog footer form menu nav search".split())
GOOD_ROLES = frozenset("article main".split())
BAD_ROLES = frozenset("alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_WORDS = frozenset("article content entry main post story".split())
BAD_WORDS = frozenset("""ad ads adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments
consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip
social sponsor sponsored subscribe subscription toolbar widget""".split())
#: Also names of what holds the article: not counted where it is inside.
WRAPPER = frozenset("banner footer header menu modal nav navbar navigation sidebar widget".split())
#: Names of elements without text blocks of their own are often made from a heading.
NAMED_BY_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr figcaption pre blockquote".split())

SURE = 6.0                # what the page says about itself
LEARNED = 3.0             # the learned part lies between -LEARNED and LEARNED
PRIOR = 20.0              # pseudo-counts of a feature
BEFORE = {"words:0": -1.0, "words:1": -0.4, "words:2": 0.8, "words:3": 1.5, "links:0": 0.5, "links:1": -0.5, "links:2": -2.0,
          "end:0": -0.3, "end:1": 0.6, "tag:p": 0.5, "tag:h": 0.5, "tag:li": -0.3, "tag:td": -0.3, "tag:pre": 0.5, "tag:div": 0.0}
OUTSIDE = 4.0             # against blocks outside of the article, where a page names one
NEXT = 0.9                # smoothness of blocks that follow each other
INSIDE = 0.7              # of an element and what it holds
UNIT = 1000               # capacities are whole numbers

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _says(tag: str, attrs: str) -> int:
    """What an element says about what it holds: 1 content, -1 boilerplate,
    -2 boilerplate unless the article is inside, -3 a header (the page's, or
    the article's own), 0 nothing."""
    role, good, bad, mixed = "", False, set(), False
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "role":
            role = value.strip().lower()
        elif key == "class" or tag not in NAMED_BY_TEXT:
            for name in value.split():
                words = {w.lower() for w in _WORD.findall(name)}
                good |= bool(words & GOOD_WORDS) and not words & BAD_WORDS
                mixed |= bool(words & GOOD_WORDS)
                bad |= words & BAD_WORDS
    if bad == {"header"} and mixed or tag == "header" and not bad and role != "banner":
        return -3
    if bad - WRAPPER or tag in BAD_TAGS - {"form"} or role in BAD_ROLES:
        return -1
    if good or tag in GOOD_TAGS or role in GOOD_ROLES:
        return 1
    return -2 if bad or tag == "form" else 0


class _Page:
    """The elements of a page (parent, tag, what they say) in page order, and
    the blocks between their tags: (element, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.says = [-1], ["body"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._links = 0
        self._read(source)

    def _flush(self, at: int) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((at, text, self._links))
            self._text, self._links = [], 0

    def _read(self, s: str) -> None:
        stack, linked, hidden, pos = [(0, "body")], False, 0, 0
        while True:
            m = _TAG.search(s, pos)
            if not hidden:
                self._text.append(s[pos:m.start() if m else len(s)])
                if linked:
                    self._links += len(self._text[-1].strip())
            if not m:
                break
            pos, name = m.end(), (m.group(2) or "").lower()
            if name in RAW and not m.group(1):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(s, pos)
                pos = end.end() if end else len(s)
            elif name == "a":
                linked = not m.group(1) and bool(_HREF.search(m.group(3)))
            elif name == "br":
                if not hidden:
                    self._text.append("\n")
            elif name not in BLOCK and name not in HIDDEN:
                continue
            elif not m.group(1):
                if name in BLOCK and not hidden:
                    self._flush(stack[-1][0])
                while len(stack) > 1 and name in CLOSES.get(stack[-1][1], ()):
                    stack.pop()
                if name in VOID or name in ("body", "html") or name in HIDDEN and m.group(3).endswith("/"):
                    continue
                at = stack[-1][0]
                if name in BLOCK:
                    self.parent.append(at)
                    self.tag.append(name)
                    self.says.append(_says(name, m.group(3)))
                    at = len(self.tag) - 1
                hidden += name in HIDDEN
                stack.append((at, name))
            else:
                if name in BLOCK and not hidden:
                    self._flush(stack[-1][0])
                    linked = False
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == name), 0)
                if k:   # an end tag that belongs to nothing open is passed over
                    hidden -= sum(t in HIDDEN for _, t in stack[k:])
                    del stack[k:]
        self._flush(stack[-1][0])

    def contexts(self) -> list[int]:
        """Of every element: 1 in the article, -1 in boilerplate, 0 neither."""
        holds = [False] * len(self.tag)
        for e in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[e]] |= (holds[e] and self.says[e] != -1) or self.says[e] == 1
        out = [0]
        for e in range(1, len(self.tag)):
            above, says = out[self.parent[e]], self.says[e]
            if above < 0 or says == -1 or says == -2 and not holds[e] or says == -3 and above < 1 and not holds[e]:
                out.append(-1)
            else:
                out.append(1 if says == 1 else above)
        return out


def _features(page: _Page, block: tuple[int, str, int]) -> tuple[str, str, str, str]:
    at, text, linked = block
    size = max(text.count(" ") + 1, len(text) / 6)   # some scripts have no spaces
    tag = page.tag[at]
    tag = "h" if len(tag) == 2 and tag[0] == "h" else "li" if tag in ("dt", "dd") else "td" if tag == "th" else tag
    return (f"words:{0 if size < 4 else 1 if size < 12 else 2 if size < 30 else 3}",
            f"links:{0 if not linked else 1 if 2 * linked < len(text) else 2}",
            f"end:{int(text[-1] in '.!?…。！？:;)»”\"')}", f"tag:{tag if f'tag:{tag}' in BEFORE else 'div'}")


def learn_shapes(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Log-odds of the shape features, from all blocks of all pages that stand
    in a marked context. Pseudo-counts hold what is assumed before."""
    def count(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for source in pdf["h"]:
                page = _Page(source)
                where = page.contexts()
                for b in page.blocks:
                    if where[b[0]]:
                        seen.update((f, where[b[0]]) for f in _features(page, b))
            yield pd.DataFrame([(f, w, n) for (f, w), n in seen.items()], columns=["feature", "w", "n"])
    rows = (pages.select(F.col(html_column).alias("h")).filter("h IS NOT NULL")
                 .mapInPandas(count, "feature string, w int, n long").groupBy("feature", "w").agg(F.sum("n").alias("n")))
    return shape_weights({(r.feature, r.w): r.n for r in rows.collect()})   # a row per feature and label


def shape_weights(counts: dict) -> dict[str, float]:
    out = {}
    for family in {f.split(":")[0] for f in BEFORE}:
        own = [f for f in BEFORE if f.split(":")[0] == family]
        p = {}
        for w in (1, -1):
            before = {f: math.exp(w * BEFORE[f] / 2) for f in own}
            total = sum(counts.get((f, w), 0) for f in own) + PRIOR
            p[w] = {f: (counts.get((f, w), 0) + PRIOR * before[f] / sum(before.values())) / total for f in own}
        out |= {f: math.log(p[1][f] / p[-1][f]) for f in own}
    return out


def _max_flow_side(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The smallest source side of a minimum cut. excess: capacity from the
    source, or to the sink if negative; edges: (a, b, capacity both ways)."""
    n = len(excess)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    # A node whose terminal outweighs all its edges is on that terminal's side
    # in every minimum cut; it then belongs to the terminal, with its edges.
    excess, side = list(excess), [0] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if not side[v] and abs(excess[v]) > sum(near[v].values()):
            side[v] = 1 if excess[v] > 0 else -1
            for u, c in near[v].items():
                del near[u][v]
                excess[u] += side[v] * c
                todo.append(u)
            near[v] = {}
    free = [v for v in range(n) if not side[v]]
    if free:
        reach = _dinic(free, excess, near)
        for v in free:
            side[v] = 1 if v in reach else -1
    return [x > 0 for x in side]


def _dinic(free: list[int], excess: list[int], rest: list[dict[int, int]]) -> set[int]:
    """Maximum flow over the nodes that are left, phase by phase along shortest
    ways; what the source still reaches then. ``rest`` are the capacities."""
    supply = {v: excess[v] for v in free if excess[v] > 0}
    demand = {v: -excess[v] for v in free if excess[v] < 0}
    while True:
        level = dict.fromkeys((v for v, x in supply.items() if x > 0), 0)
        queue, ends = deque(level), False
        while queue:
            v = queue.popleft()
            ends = ends or demand.get(v, 0) > 0
            for u, c in rest[v].items():
                if c > 0 and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not ends:
            return set(level)
        ways = {v: [u for u in rest[v] if level.get(u, -1) == level[v] + 1] for v in level}
        for start in [v for v, x in supply.items() if x > 0]:
            path = [start]
            while path and supply[start] > 0:
                v = path[-1]
                if demand.get(v, 0) > 0:
                    flow = min([supply[start], demand[v]] + [rest[a][b] for a, b in zip(path, path[1:])])
                    supply[start] -= flow
                    demand[v] -= flow
                    for a, b in zip(path, path[1:]):
                        rest[a][b] -= flow
                        rest[b][a] += flow
                    cut = next((i for i, (a, b) in enumerate(zip(path, path[1:])) if not rest[a][b]), len(path) - 1)
                    del path[cut + 1:]
                elif ways[v] and rest[v][ways[v][-1]] > 0:
                    path.append(ways[v][-1])
                elif ways[v]:
                    ways[v].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def label_blocks(page: _Page, weights: dict[str, float]) -> list[bool]:
    """Which blocks are content."""
    where, k = page.contexts(), len(page.blocks)
    named = any(where[at] > 0 for at, _, _ in page.blocks)
    titled = any(where[at] > 0 and page.tag[at] == "h1" for at, _, _ in page.blocks)
    excess, edges = [], []
    for i, block in enumerate(page.blocks):
        at = block[0]
        score = max(-LEARNED, min(LEARNED, sum(weights[f] for f in _features(page, block)))) + SURE * where[at]
        if named and not where[at] and (titled or page.tag[at] != "h1"):
            score -= OUTSIDE
        excess.append(round(UNIT * score))
        edges.append((i, k + at, round(UNIT * INSIDE)))
        if i:
            edges.append((i - 1, i, round(UNIT * (NEXT if page.parent[at] == page.parent[page.blocks[i - 1][0]] else NEXT / 2))))
    edges += [(k + e, k + page.parent[e], round(UNIT * INSIDE)) for e in range(1, len(page.tag))]
    return _max_flow_side(excess + [0] * len(page.tag), edges)[:k]


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = _Page(source)
    return "\n".join(b[1] for b, keep in zip(page.blocks, label_blocks(page, weights)) if keep)


def extract_text(pages: DataFrame, html_column: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with (text, n_chars) instead of the html: the blocks of the
    main text in page order, joined by a line feed.

    A block is the text between two block-level tags, with character references
    decoded and white space turned into one space (a line break is white
    space). A null or empty page, and one without content, gives an empty text.
    Cells of tables are blocks. Broken markup is read as far as it goes: an end
    tag that nothing opened is passed over, an unclosed element ends with the
    one around it, an unclosed comment or script hides the rest. Of labels that
    cost the same, boilerplate is taken. Repeated rows are labelled each, other
    columns are kept (but a column named text or n_chars is replaced).
    """
    weights = weights or learn_shapes(pages, html_column)
    rows = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c != html_column])
    rows = rows.withColumnRenamed(html_column, "text")
    at = rows.columns.index("text")

    def label(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x, weights) for x in part.column(at).to_pylist()]
                yield part.set_column(at, "text", pa.array(texts, part.schema.field(at).type))
    return rows.mapInArrow(label, rows.schema).withColumn("n_chars", F.length("text").cast("bigint"))
