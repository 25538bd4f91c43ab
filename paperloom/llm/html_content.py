"""Main text of web pages by minimum-cut labelling.

A page is parsed into text blocks (what stands between block-level tags) and
the elements that hold them. A classifier over the text and the place of a
block gives its log-odds of being content, at most ``MOST`` either way; these
are its terminal capacities in a flow network. Elements are nodes too: what
their tags, roles and names say (an article, a menu, a sidebar) is their
capacity. Smoothness edges, the price of labelling two nodes differently, tie
a block to its element, an element to the one around it, and blocks that are
neighbours. The minimum cut, found by maximum flow, separates content from
boilerplate: it carries what an element says to its blocks, however they read
alone, and on pages whose elements say nothing it lets a block's neighbours
and kin decide where its own words don't. A node whose capacity exceeds all its
edges keeps its own side in every minimum cut, so such nodes are merged into
the terminals before the flow is sought.

The classifier is logistic, over yes-or-no features of a block. It is trained
on the pages at hand: of a sample of at most SAMPLE pages (those of least
hash), pages with an article or main element label their own blocks by what
their elements say, counted by pattern of features; the classifier sees the
features only. Weights are drawn towards PRIOR, which hold without such pages.

Defined results: a null or empty page has empty text; markup that can't be
parsed counts as text; a page without content has empty text; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .session import read_table

#: Pages that the classifier is trained on, at most.
SAMPLE = 500
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul title button".split()
)
SILENT = frozenset("script style noscript template iframe object svg annotation annotation-xml head title canvas audio video noframes".split())
#: What a head may hold; any other start tag ends one that was left open.
IN_HEAD = frozenset("base link meta noscript script style template title head".split())
#: Always boilerplate, with all that they hold.
APART = frozenset("nav aside footer menu dialog".split())
FORM = frozenset("form button select textarea option fieldset label".split())
CLOSES_P = BLOCK - {"option", "button", "html", "head", "body", "title"}
OUT = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|newsletter|subscribe\w*|subscription|signup|login|paywall|"
    r"comment\w*|disqus\w*|replies|reply|responses|respond|reader\w*|sidebar\w*|side|aside|nav\w*|menu\w*|breadcrumbs?|crumbs|pagination|pager|toolbar|footer\w*|foot|masthead|"
    r"topbar|share\w*|sharing|social\w*|related\w*|recommend\w*|trending|popular|teaser\w*|widget\w*|tagcloud|copyright|legal|disclaimer|skip\w*|hidden|search\w*|outbrain|taboola)",
    re.I,
)
#: Boilerplate in a name of their own, but parts of an article in a name with one of IN.
HEADS = re.compile(r"(?:header|meta|byline|tags)", re.I)
IN = re.compile(r"(?:article\w*|main|content|story\w*|entry|post|body|text|prose)", re.I)
#: Words that tell of a state or a frame: such a name says nothing of what the element holds.
STATES = frozenset("no has with without is open closed enabled disabled active wrap wrapper container layout".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}

#: Features of a block and the log-odds of content that they are drawn towards.
PRIOR = {"any": -1.0, "tiny": -1.0, "middling": 1.5, "long": 2.5, "some_links": -1.0, "links": -4.0, "sentence": 0.7, "copyright": -3.0, "title": 3.0, "heading": 0.5, "paragraph": 1.5, "item": -0.5}
#: How hard, and the most that a block's own words count.
PULL, MOST = 30.0, 5.0
#: What an element says, per edge that it has: it outweighs them all.
SAYS = {"inside": 1.1, "apart": -1.1}
#: Prices of a difference: of a block and an element that says something, of kin otherwise, of neighbours in one element, and of others.
TIE, KIN, NEXT, FAR = 6.0, 0.6, 0.8, 0.2
#: What names and forms say where no element around does, and what a page says that has an article somewhere: weak evidence.
WEAK = {"holder": 3.0, "form": -8.0, "outside": -3.0}


def named(told: str) -> str:
    """What class names and an id say: ``apart``, ``holder`` or nothing. In a compound what it is part of counts."""
    holder = False
    for name in told.split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if STATES & {p.lower() for p in parts}:
            continue
        inner = any(IN.fullmatch(p) for p in parts)
        if any(OUT.fullmatch(p) for p in parts) or re.fullmatch(r"sr-only|print-only|visually-hidden|top-bar", name, re.I) or not inner and any(HEADS.fullmatch(p) for p in parts):
            return "apart"
        holder |= inner
    return "holder" if holder else ""


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, str]] = [("", 0, "")]  # tag, number, standing
        self.above = [0]  # by number, the block-level element around
        self.says = [""]
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.links = 0
        self.paragraphs = 0

    def standing(self, tag: str, attrs: list) -> str:
        above = self.stack[-1][2]
        if above == "apart":
            return above
        a = dict(attrs)
        told = f"{a.get('class') or ''} {a.get('id') or ''}"
        style = (a.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag == "footer" and not hidden and any(t == "blockquote" for t, _, _ in self.stack):
            return above  # names the source of a quotation
        if tag in APART or hidden or (a.get("role") or "").lower() in ROLES or tag == "header" and above != "inside":
            return "apart"
        said = named(told) if tag not in ("html", "body") else ""
        if tag in ("article", "main") or (a.get("role") or "").lower() in ("main", "article"):
            return "apart" if tag == "article" and said == "apart" else "inside"
        if said == "apart" or said == "holder" and above != "inside":
            return said
        return "form" if tag in FORM else above

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = len(self.stack) - 1
                while at and self.stack[at][0] not in BLOCK:
                    at -= 1
                self.blocks.append({"text": text, "tag": self.stack[at][0], "standing": self.stack[-1][2], "element": self.stack[-1][1], "links": min(1.0, self.linked / max(1, len(text)))})
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and any(t == "head" for t, _, _ in self.stack[:3]):
            self.close_to("head", ())
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in CLOSES_P and self.paragraphs:
            self.close_to("p", ("table", "td", "th", "article", "section", "div", "body"))
        if tag == "li":
            self.close_to("li", ("ul", "ol", "menu"))
        elif tag in ("td", "th", "tr"):
            self.close_to(tag, ("table",))
        elif tag in ("dt", "dd"):
            self.close_to("dt", ("dl",))
            self.close_to("dd", ("dl",))
        if tag in VOID:
            return
        own = self.standing(tag, attrs)
        if tag in BLOCK or own != self.stack[-1][2]:
            self.above.append(self.stack[-1][1])
            self.says.append(own)
            self.stack.append((tag, len(self.says) - 1, own))
        else:  # words within a block
            self.stack.append((tag, self.stack[-1][1], own))
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.links += 1
        elif tag == "p":
            self.paragraphs += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close_to(self, tag: str, scope: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.drop(i)
                return
            if self.stack[i][0] in scope:
                return

    def drop(self, i: int) -> None:
        self.flush()
        for t, _, _ in self.stack[i:]:
            if t in SILENT:
                self.silent -= 1
            elif t == "a":
                self.links -= 1
            elif t == "p":
                self.paragraphs -= 1
        del self.stack[i:]

    def handle_endtag(self, tag):
        if tag == "p" and not self.paragraphs:
            self.flush()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCK or any(x[0] in BLOCK for x in self.stack[i:]):
                    self.drop(i)
                else:
                    held, self.parts = self.parts, []
                    self.drop(i)
                    self.parts = held
                return

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self.close_to("head", ())
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parsed(html: str) -> _Blocks:
    try:
        p = _Blocks()
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):
        p = _Blocks()
        p.feed(html.replace("<![", "&lt;!["))
        p.close()
    p.flush()
    return p


def features(b: dict) -> int:
    """The features of a block as bits, in the order of PRIOR."""
    n, end = len(b["text"].split()), b["text"][-1]
    head = b["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6")
    told = (
        True, n < 4 and not head, 8 <= n < 20, n >= 20, 0 < b["links"] <= 0.5, b["links"] > 0.5, end in ".!?…\"'”’»", "©" in b["text"] or "all rights reserved" in b["text"].lower(),
        b["tag"] == "h1", head and b["tag"] != "h1", b["tag"] == "p", b["tag"] == "li",
    )
    return sum(1 << i for i, x in enumerate(told) if x)


def labelled(html: str | None) -> Counter:
    """(features, is content) of the blocks of a page that has an article or main element, counted."""
    p = parsed(html) if html else None
    if p is None or "inside" not in p.says:
        return Counter()
    return Counter((features(b), b["standing"] == "inside") for b in p.blocks if b["standing"] in ("inside", "apart"))


def fit(counts: dict[tuple[int, bool], int], rounds: int = 50) -> np.ndarray:
    """Weights of the features, by Newton's method; drawn towards PRIOR."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    if not counts:
        return w
    x = np.array([[k >> i & 1 for i in range(len(prior))] for k, _ in counts], float)
    y, n = np.array([float(c) for _, c in counts]), np.array(list(counts.values()), float)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + PULL / 2 * ((w - prior) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), x.T @ (n * (y - p)) - PULL * (w - prior))
        while loss(w + move) > loss(w) and np.abs(move).max() > 1e-9:  # too far
            move = move / 2
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def scores_of(blocks: list[dict], weights: np.ndarray) -> list[float]:
    """Log-odds of content of each block by its own features."""
    known: dict[int, float] = {}
    out = []
    for b in blocks:
        f = features(b)
        if f not in known:
            known[f] = float(np.clip(sum(w for i, w in enumerate(weights) if f >> i & 1), -MOST, MOST))
        out.append(known[f])
    return out


def network(p: _Blocks, weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores and edges: the blocks' first, then those of the elements around them."""
    scores, edges = scores_of(p.blocks, weights), []
    number: dict[int, int] = {}
    for b in p.blocks:
        e = b["element"]
        while e not in number:
            number[e] = len(scores)
            said = ("outside" if "inside" in p.says else "") if not e else p.says[e] if p.says[e] != p.says[p.above[e]] else ""
            scores.append(WEAK.get(said, 0.0))
            e = p.above[e]
    for i, b in enumerate(p.blocks):
        edges.append((i, number[b["element"]], TIE if b["standing"] else KIN))
        if i:
            same = p.blocks[i - 1]["standing"] == b["standing"]
            edges.append((i - 1, i, NEXT if same else FAR))
    for e, at in number.items():
        if e:  # an element that says what the one around doesn't is not tied to it
            edges.append((at, number[p.above[e]], (TIE if p.says[e] else KIN) if p.says[e] == p.says[p.above[e]] else FAR))
    total: dict[int, float] = {}
    for a, b, w in edges:
        for k in (a, b):
            total[k] = total.get(k, 0.0) + w
    for e, at in number.items():
        if p.says[e] in SAYS and (not e or p.says[e] != p.says[p.above[e]]):
            scores[at] = SAYS[p.says[e]] * (total[at] + 1)
    return scores, edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut.

    Positive scores are capacities from the source, negative ones to the sink;
    edges count both ways.
    """
    n, scale = len(scores), 1000
    s = [round(x * scale) for x in scores]
    joined = [(a, b, round(w * scale)) for a, b, w in edges if a != b]
    side: list[bool | None] = [None] * n
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in joined:
        around[a].append((b, w))
        around[b].append((a, w))
    # Persistent nodes, again and again as neighbours become fixed.
    open_ = [sum(w for _, w in x) for x in around]
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(s[i]) > open_[i]:
            side[i] = s[i] > 0
            for j, w in around[i]:
                if side[j] is None:
                    s[j] += w if side[i] else -w
                    open_[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, x in zip(rest, flow_side(rest, s, [(a, b, w) for a, b, w in joined if side[a] is None and side[b] is None]), strict=True):
            side[i] = x
    return [bool(x) for x in side]


def flow_side(rest: list[int], s: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which of ``rest`` the source still reaches after a maximum flow (by blocking flows over levels)."""
    number = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    head: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    to: list[int] = []
    cap: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i in rest:
        if s[i]:
            add(*((source, number[i]) if s[i] > 0 else (number[i], sink)), abs(s[i]), 0)
    for a, b, w in joined:
        add(number[a], number[b], w, w)
    while True:
        level = [-1] * len(head)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in head[a]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[number[i]] >= 0 for i in rest]
        at = [0] * len(head)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if cap[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def content(p: _Blocks, weights: np.ndarray) -> list[bool]:
    return min_cut(*network(p, weights))[: len(p.blocks)]


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    if not html:
        return ""
    p = parsed(html)
    kept = content(p, fit({}) if weights is None else weights) if p.blocks else []
    return "\n\n".join(b["text"] for b, c in zip(p.blocks, kept, strict=True) if c)


def train(pages: DataFrame, *, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` different pages; equal ones count each.

    The sample is told by a bound on the hash, so no page leaves its task. What
    comes to the driver are counts by pattern of features, bounded by the
    number of patterns.
    """
    some = pages.select(F.col(html).alias("html")).filter("html is not null")
    bound = some.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(sample).groupBy().agg(F.max("h").alias("h")).first()["h"]
    some = some.filter(F.xxhash64("html") <= F.lit(bound).cast("long"))

    def make():
        def f(b):
            total: Counter = Counter()
            for h in b.column(0).to_pylist():
                total += labelled(h)
            return {"pattern": [k for k, _ in total], "content": [c for _, c in total], "n": list(total.values())}

        return f

    counted = map_batches(some, make, "pattern int, content boolean, n long").groupBy("pattern", "content").agg(F.sum("n").alias("n")).orderBy("pattern", "content")
    return fit({(r["pattern"], r["content"]): r["n"] for r in counted.collect()})


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """key, url, text and n_chars: one row per row of ``pages``, which is read three times."""
    weights = train(pages, html=html, sample=sample)

    def make():
        def f(b):
            texts = [main_text(h, weights) for h in b.column(2).to_pylist()]
            return {"key": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    spec = f"key {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long"
    return map_batches(pages.select(key, url, html), make, spec).withColumnRenamed("key", key)


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
