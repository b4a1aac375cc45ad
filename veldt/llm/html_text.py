"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A classifier gives each block the costs of calling it content or
boilerplate, which are its capacities to the two terminals; blocks that follow one another, or are neighbours
under one parent, are joined by edges the stronger the nearer they stand in the document tree. The minimum cut,
found by maximum flow, is the labelling of least total cost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import bound_batches

#: Pages a fit looks at, at most: those with the smallest hashes.
SAMPLE = 2000
#: Logits that structure lends to a block, the bound on what its format adds, and the strength of a tree-adjacent edge.
CONTENT, BOILER, OUTSIDE, BOUND, SMOOTH = 5.0, -5.0, -2.5, 1.5, 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
SILENT = frozenset("script style head title noscript template svg math iframe object canvas audio video datalist".split())
LOOSE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
BAD_TAGS = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside widget related recommended share sharing social ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form comment comments disqus reply replies respond responses discussion pagination pager tags toolbar copyright legal disclaimer skip".split())
GOOD_NAMES = frozenset("article content main post entry story maintext articlebody".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}
#: Words in a compound name that make it say what a page has, not what a part is.
ABOUT = frozenset("with has no without is wrapper container page layout site".split())

#: Format features: bias, log words, link share, ends like a sentence, heading, list item, digits, marks.
N_FEATURES = 8
PRIOR = np.array([-0.5, 0.6, -3.0, 0.8, 0.6, -0.5, -0.5, 0.2])


Block = tuple[str, int, tuple[int, int, int], str, int]


#: Names of readers' comments; inside an article a discussion is a part of it.
COMMENTS = frozenset("comment comments disqus reply replies respond responses discussion".split())


def evidence(tag: str, attrs: dict[str, str | None], article: bool = False) -> int:
    """1 if an element says it holds the article, -1 if it says it does not, else 0; comments are -2.

    Names on body and html describe the page and decide nothing. article: whether the element is inside an article.
    """
    names = [n for key in ("class", "id") for n in re.split(r"\s+", (attrs.get(key) or "").lower()) if n]
    words = [[w for w in re.split(r"[-_]+", n) if w] for n in names]
    said = [w for ws in words if not ABOUT.intersection(ws) for w in ws]
    if article:
        said = [w for w in said if w != "discussion"]
    if tag not in ("body", "html") and any(w in COMMENTS for w in said):
        return -2
    if tag in GOOD_TAGS:
        return 1
    if tag in BAD_TAGS or ROLES.get((attrs.get("role") or "").lower(), 0) < 0 or "hidden" in attrs:
        return -1
    if tag not in ("body", "html") and any(w in BAD_NAMES for w in said):
        return -1
    if ROLES.get((attrs.get("role") or "").lower(), 0) > 0 or tag not in ("body", "html") and any(w in GOOD_NAMES for w in said):
        return 1
    return 0


class Page(HTMLParser):
    """Collects blocks: (text, letters in links, place, tag, standing).

    A place is (depth, depth shared with the block before, number of the element around the innermost one), all
    counted in block elements; none of it costs more the deeper elements nest.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, number, standing
        self.path: list[tuple[str, int, int]] = []  # of the block elements: tag, number, place in the stack
        self.open: Counter[str] = Counter()
        self.n, self.links, self.silent, self.in_link, self.good, self.shared = 0, 0, 0, 0, 0, 0
        self.buffer: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        if text:
            depth = len(self.path)
            place = (depth, self.shared, self.path[-2][1] if depth > 1 else 0)
            self.blocks.append((text, min(self.links, len(text)), place, self.path[-1][0] if depth else "", self.stack[-1][2] if self.stack else 0))
            self.shared = depth
        self.buffer, self.links = [], 0

    def leave(self, at: int) -> None:
        for t, *_ in self.stack[at:]:
            self.silent -= t in SILENT
            self.in_link -= t == "a"
            self.good -= t in GOOD_TAGS
            self.open[t] -= 1
        del self.stack[at:]
        while self.path and self.path[-1][2] >= at:
            self.path.pop()
        self.shared = min(self.shared, len(self.path))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            around = LOOSE.get(tag)
            for t, _, i in reversed(self.path):
                if t == "p" and tag != "br" or around and t == tag or t in ("td", "th") and tag in ("td", "th", "tr") or t in ("dd", "dt") and tag in ("dd", "dt"):
                    self.leave(i)
                    break
                if not around or t in around:
                    break
        if tag == "body" and self.open["head"]:
            self.leave(next(i for i, x in enumerate(self.stack) if x[0] == "head"))
        if tag in VOID:
            return
        self.n += 1
        above, said = (self.stack[-1][2] if self.stack else 0), evidence(tag, dict(attrs), bool(self.good))
        if tag == "header" and not self.good:
            said = min(said, -1)
        if above == -2 or above == -1 and not (said > 0 and tag in GOOD_TAGS):
            now = min(above, said) if said < 0 else above
        else:
            now = said or above
        if tag in BLOCK:
            self.path.append((tag, self.n, len(self.stack)))
        self.stack.append((tag, self.n, now))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.in_link += tag == "a"
        self.good += tag in GOOD_TAGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            self.leave(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)
            if self.in_link:
                self.links += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page; a tag that the page's end cuts off is not text."""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<(?:[a-zA-Z/!?]|$)", html[cut:]):
        html = html[:cut]
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return page.blocks


def features(block: Block) -> list[float]:
    text, links, _, tag, _ = block
    n = len(text)
    return [1.0, math.log1p(text.count(" ") + 1), links / n, float(text[-1] in ".!?:;\"'”»…"), float(tag[:1] == "h" and tag[1:].isdigit()), float(tag == "li"), sum(map(str.isdigit, text)) / n, float("," in text)]


def standing(blocks: list) -> list[float]:
    """Structure's logit of each block; where a page names its article, all that stands outside is doubtful."""
    named = any(b[4] > 0 for b in blocks)
    return [CONTENT if b[4] > 0 else BOILER if b[4] < 0 else OUTSIDE if named else 0.0 for b in blocks]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge towards PRIOR; without both labels PRIOR itself."""
    w = PRIOR.copy()
    if len(y) == 0 or y.min() == y.max():
        return w
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(N_FEATURES)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - (w - PRIOR))
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; edges are undirected. Maximum flow by levels (Dinic)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in range(n):  # what flows straight through a node is taken off beforehand
        left = source[v] - sink[v]
        if left > 0:
            add(s, v, left, 0.0)
        elif left < 0:
            add(v, t, -left, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        at, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                flow = min([room[e] for e in path])
                first = len(path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= 1e-12 and k < first:
                        first = k
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def label(blocks: list[Block], weights: np.ndarray, smooth: float = SMOOTH) -> list[bool]:
    """True for content; without smoothness each block is judged alone."""
    if not blocks:
        return []
    shape = np.array([features(b) for b in blocks]) @ weights
    source, sink = [], []
    for base, z in zip(standing(blocks), shape.tolist(), strict=True):
        z = base + (max(-BOUND, min(BOUND, z)) if base else z)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        sink.append(-math.log(max(p, 1e-12)))  # paid when called content
        source.append(-math.log(max(1 - p, 1e-12)))  # paid when called boilerplate
    edges, last = [], {}
    for i, (_, _, (depth, shared, parent), *_) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, smooth / (1 + blocks[i - 1][2][0] + depth - 2 * shared)))
        if (j := last.get(parent)) is not None and j != i - 1:
            edges.append((j, i, smooth / 3))
        last[parent] = i
    return min_cut(source, sink, edges)


def main_text(html: str, weights: np.ndarray) -> str:
    blocks = blocks_of(html)
    return " ".join([b[0] for b, good in zip(blocks, label(blocks, weights), strict=True) if good])


def train(pages: DataFrame, sample: int = SAMPLE, html: str = "html") -> np.ndarray:
    """Weights of the format features, from blocks whose page's structure says what they are, of at most ``sample`` pages."""
    bound_batches(pages.sparkSession)
    held = pages.select(F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html")).withColumn("h", F.xxhash64("html"))
    least = held.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return PRIOR.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, xs, ys = [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blocks = [x for x in blocks_of(t.as_py()) if x[4]]
                x, y = np.array([features(x) for x in blocks]).reshape(-1, N_FEATURES), np.array([x[4] > 0 for x in blocks], float)
                # a page sends its sums by label, so that a long page weighs no more than a short one
                for one in (0.0, 1.0):
                    if (y == one).any():
                        hs.append(h), xs.append(x[y == one].mean(axis=0).tolist()), ys.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["h", "x", "y"])

    rows = held.filter(F.col("h") <= least).dropDuplicates(["h"]).select("h", "html").mapInArrow(run, "h long, x array<double>, y double").orderBy("h", "y").collect()
    return fit(np.array([r.x for r in rows]).reshape(-1, N_FEATURES), np.array([r.y for r in rows]))


def extract(pages: DataFrame, weights: np.ndarray | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html.

    Null or empty html, or a page of boilerplate alone, gives an empty text. Broken and cut-off markup is read as
    far as it goes. Null urls and ids are passed through; repeated rows each give a row; an empty table gives
    none; other columns are not read. No shuffle.
    """
    bound_batches(pages.sparkSession)
    w = train(pages, html=html) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(t.as_py(), w) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null or empty html gives an empty text, repeated rows and null ids stay."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
