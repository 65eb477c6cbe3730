"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with the elements around them. A block's odds
of being article text come from two sides. The meaning of its elements (their
tags, roles, class and id words) gives fixed odds, strong where a page says
what it means. The shape of its text (length, links, punctuation, heading) is
judged by a logistic regression, trained on a bounded sample of blocks whose
elements do say what they are, and trusted up to SHAPE_TRUST either way. The
odds become capacities to the two terminals. Neighbours in reading order, and
consecutive children of one element, are joined by smoothness edges that weaken
with distance in the element tree; an edge outweighs what shape alone says, so
that a short line among paragraphs, or a long one in a menu, goes with its
neighbours. The minimum cut, found by maximum flow, separates content from
boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C

# Fixed values of the HTML standard and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
UNSEEN = frozenset("noscript template select button svg canvas video audio datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("head html body".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
AWAY_TAGS = frozenset("nav footer aside form header menu dialog search head".split())
TOWARDS_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright cta disqus donate follow footer form gdpr header login masthead menu menubar modal nav navbar navigation navi newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets alert warning disclaimer legal discussion feedback".split()
)
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOWARDS_WORDS = frozenset("article articlebody post postbody entry story content main maincontent text body".split())
EXEMPT = frozenset("has with no without is".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
MARK = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SENTENCE = re.compile(r"[.!?,;:…。！？]")
WORDS = re.compile(r"\S+")
#: Log odds: of an element that holds boilerplate, of an article, of a hopeful name, of a block outside the page's article, of a hidden element.
AWAY, ARTICLE, NAMED, OUTSIDE, HIDDEN = -7.0, 3.0, 1.5, -4.0, -1.5
#: The most that the text's shape counts either way, and the smoothness between blocks that lie side by side.
SHAPE_TRUST, SMOOTH = 2.0, 2.0
#: Pages that the shape's weights are learned from, their longest html in bytes, and the blocks taken.
FIT_PAGES, FIT_BYTES, FIT_BLOCKS = 400, 1 << 18, 20_000
#: Weights where no page tells its article from the rest: of 1 and the features of shape().
UNTAUGHT = (-3.0, 0.9, -4.0, 1.0, 1.0, 1.0)


class Block:
    __slots__ = ("path", "text", "linked", "leaning", "heading")

    def __init__(self, path, text, linked, leaning, heading):
        self.path, self.text, self.linked, self.leaning, self.heading = path, text, linked, leaning, heading


def leaning(tag: str, attributes: str) -> int:
    """Whether an element by its meaning holds boilerplate (-1), article text (1), or doesn't tell (0); 9: hidden."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in MARK.finditer(attributes)} if attributes and attributes.strip() else {}
    if found:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return 9
        if found.get("role", "").lower() in AWAY_ROLES:
            return -1
    if tag in AWAY_TAGS:
        return -1
    if tag in TOWARDS_TAGS:
        return 1
    if tag in ("html", "body"):
        return 0
    mark = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if EXEMPT & set(words):
            continue
        if AWAY_WORDS & set(words):
            return -1
        if TOWARDS_WORDS & set(words):
            mark = 1
    return mark


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; markup errors are mended as browsers do, roughly."""
    out: list[Block] = []
    stack: list[tuple[int, str, int]] = []  # number, tag, leaning
    pieces: list[str] = []
    linked, links, number, raw, lower = 0, 0, 0, "", None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for _, t, _ in stack[-2:])
                out.append(Block(tuple(n for n, _, _ in stack), text, min(1.0, linked / max(1, len(text))), [(t, m) for _, t, m in stack if m], heading))
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        flush()
        del stack[at:]

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[0].endswith(">"):
            break  # a tag that the page's end cuts off is no text
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCK or any(t == tag for _, t, _ in stack):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] == tag:
                        close(k)
                        links = 0 if tag in BLOCK else links
                        break
                else:
                    flush()
            continue
        if tag in RAW or tag in UNSEEN:
            if not m[3].rstrip().endswith("/") or tag != "svg":
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == len(page) else page
                end = past(lower, tag, at, stack[-1][1] if stack and tag in UNSEEN else "")
                if end >= 0:
                    at = end
                elif tag in RAW:
                    break  # as browsers read it, the rest is its text
            continue
        if tag in ("br", "wbr", "img"):
            pieces.append(" " if tag != "wbr" else "")
            continue
        if tag == "a":
            links = 1
            continue
        if tag in CLOSES_P:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == "p" or (tag in SIBLINGS and stack[k][1] in SIBLINGS[tag]):
                    close(k)
                    break
                if stack[k][1] in BLOCK:
                    break
        if tag in VOID:
            continue
        if tag == "body":
            flush()
            for k, entry in enumerate(stack):
                if entry[1] == "head":
                    close(k)
                    break
        if tag in BLOCK:
            flush()
            number += 1
            stack.append((number, tag, leaning(tag, m[3])))
        elif m[3] and (mark := leaning(tag, m[3])) in (-1, 9):
            flush()
            number += 1
            stack.append((number, tag, mark))
    flush()
    return out


def past(page: str, tag: str, at: int, parent: str) -> int:
    """Where the element that opened before at has ended, by its end tag; -1 if there is none before the parent's."""
    stop = page.find(f"</{parent}", at) if parent else -1
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])").finditer(page, at, stop if stop >= 0 else len(page)):
        depth += -1 if m[1] else 1
        if not depth:
            return page.find(">", m.start()) + 1 or -1
    return -1


def shape(b: Block) -> tuple[float, ...]:
    """1, then length, share of linked text, signs per word, a sentence's end, a heading."""
    words = len(WORDS.findall(b.text))
    return 1.0, math.log1p(len(b.text)), b.linked, min(1.0, len(SENTENCE.findall(b.text)) / words), float(b.text[-1] in ".!?。！？…"), float(b.heading)


def taught(b: Block) -> int | None:
    """What a block's elements say for certain: 1 article text, 0 boilerplate, None nothing."""
    marks = {m for _, m in b.leaning}
    if -1 in marks:
        return 0 if not any(t in TOWARDS_TAGS for t, _ in b.leaning) else None
    return 1 if any(t in TOWARDS_TAGS and m > 0 for t, m in b.leaning) else None


def learn(rows: list[tuple[float, ...]], labels: list[int]) -> tuple[float, ...]:
    """Logistic regression by Newton steps, slightly drawn to 0; classes weigh alike; UNTAUGHT unless both are there."""
    if len(set(labels)) < 2:
        return UNTAUGHT
    x, y = np.array(rows), np.array(labels, float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2 * len(y))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def evidence(b: Block, has_article: bool, weights: tuple[float, ...] = UNTAUGHT) -> float:
    """Log odds that the block is article text."""
    inside = any(t in TOWARDS_TAGS for t, m in b.leaning if m > 0)
    z = ARTICLE if inside else (NAMED if any(m == 1 for _, m in b.leaning) else 0.0)
    for tag, mark in b.leaning:
        if mark == -1:
            z += -1.0 if tag == "header" and inside and b.heading else AWAY
        elif mark == 9:
            z += HIDDEN if not inside else 0.0
    if has_article and not inside:
        z += OUTSIDE
    return z + max(-SHAPE_TRUST, min(SHAPE_TRUST, sum(a * x for a, x in zip(weights, shape(b)))))


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (shortest augmenting paths, level by level)."""
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a: int, b: int, c: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b), cap.append(c)
        graph[b].append(len(to))
        to.append(a), cap.append(back)

    for i in range(n):
        add(s, i, source[i], 0.0)
        add(i, t, sink[i], 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def label(found: list[Block], weights: tuple[float, ...] = UNTAUGHT) -> list[bool]:
    """Content (True) or boilerplate for each block, by the minimum cut."""
    has_article = any(t in TOWARDS_TAGS and m > 0 for b in found for t, m in b.leaning)
    z = [evidence(b, has_article, weights) for b in found]
    edges: dict[tuple[int, int], float] = {}

    def smooth(i: int, j: int, by: float) -> None:
        p, q = found[i].path, found[j].path
        shared = 0
        for x, y in zip(p, q):
            if x != y:
                break
            shared += 1
        apart = len(p) + len(q) - 2 * shared
        if [m for _, m in found[i].leaning if m < 0] != [m for _, m in found[j].leaning if m < 0]:
            apart += 4
        edges[i, j] = edges.get((i, j), 0.0) + by * SMOOTH * math.exp(-apart / 3)

    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            smooth(i - 1, i, 1.0)
        parent = b.path[-2] if len(b.path) > 1 else -1
        if parent in last and last[parent] != i - 1:
            smooth(last[parent], i, 0.5)
        last[parent] = i
    # A block whose own odds outweigh all its edges keeps its label in every minimum cut.
    weight = [0.0] * len(found)
    for (i, j), c in edges.items():
        weight[i] += c
        weight[j] += c
    fixed = {i: z[i] > 0 for i in range(len(found)) if abs(z[i]) > weight[i]}
    free = [i for i in range(len(found)) if i not in fixed]
    if not free:
        return [fixed[i] for i in range(len(found))]
    number = {i: k for k, i in enumerate(free)}
    source, sink = [max(0.0, z[i]) for i in free], [max(0.0, -z[i]) for i in free]
    inner = []
    for (i, j), c in edges.items():
        if i in number and j in number:
            inner.append((number[i], number[j], c))
        elif i in number or j in number:
            own, other = (i, j) if i in number else (j, i)
            (source if fixed[other] else sink)[number[own]] += c
    side = max_flow_side(len(free), source, sink, inner)
    return [fixed[i] if i in fixed else side[number[i]] for i in range(len(found))]


def main_text(page: str | None, weights: tuple[float, ...] = UNTAUGHT) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, keep in zip(found, label(found, weights)) if keep)


def fit(pages: DataFrame, html_col: str = "html") -> tuple[float, ...]:
    """Weights of the text's shape, learned from blocks whose elements say what they are.

    At most FIT_BLOCKS blocks of FIT_PAGES pages are taken, first by the hash of
    the html, none of a page over FIT_BYTES. Without any, UNTAUGHT.
    """
    C.prepare(pages.sparkSession)
    chosen = pages.select(F.col(html_col).alias("html")).where(F.octet_length("html") <= FIT_BYTES)
    chosen = chosen.orderBy(F.xxhash64("html"), "html").limit(FIT_PAGES)

    def shapes(batches):
        room = FIT_BLOCKS
        for batch in batches:
            rows = [(taught(b), shape(b)) for page in batch.column(0).to_pylist() for b in blocks(page)]
            rows = [(t, x) for t, x in rows if t is not None][:room]
            room -= len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([list(x) for _, x in rows], pa.list_(pa.float64()))], names=["label", "shape"])

    rows = chosen.mapInArrow(shapes, "label int, shape array<double>").limit(FIT_BLOCKS).collect()
    return learn([tuple(r["shape"]) for r in rows], [r["label"] for r in rows])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] = ("page_id", "url"), weights: tuple[float, ...] | None = None) -> DataFrame:
    """The kept columns, text (empty if there is none) and n_chars (its code points), one row a page.

    A null page is an empty one. Nulls and repeats in kept columns stay as they
    are; other columns are not read. Kept columns can't be named text or n_chars.
    A page of any length is read whole. An empty table gives no row.
    """
    C.prepare(pages.sparkSession)
    if clash := {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    weights = fit(pages, html_col) if weights is None else weights
    chosen = pages.select(F.col(html_col), *keep)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]), "text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    return chosen.mapInArrow(run, out)
