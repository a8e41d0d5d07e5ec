"""Main text of web pages by minimum cut.

A page becomes a row of text blocks, each with its path of elements. A logistic
classifier on a block's own text, links, place and depth gives the cost of
calling it content or boilerplate; what its path is called (``mark``) is one
more term of fixed weight. These costs are the capacities to the two terminals.
Blocks next to each other, and blocks that share a close parent, are tied by
edges whose capacity falls with their distance in the tree. The minimum cut of
this graph is the labelling of least total cost; content blocks are joined.

The classifier sees nothing of the marks that label its training blocks. So it
takes short lines of an article for boilerplate, and a name like share-price
speaks against a paragraph; it is the ties to the blocks around that decide.

Scripts, styles, comments of the markup, head, forms and the like are no text
and never become blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import lean, sampled, slices, trimmed

#: Capacity between neighbouring blocks under one parent, which halves with each step of distance in the tree, and between a parent's blocks and the one of them with most text.
SMOOTH, HUB = 1.2, 1.0
#: What a mark of 1 changes in the cost.
MARK_COST = 7.0
#: Pages that the classifier is fitted on, at most; taken by a hash of page_id.
TRAIN_PAGES = 2000
#: A block costs at most this much more as one class than as the other.
MOST_COST = 8.0

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
#: Elements whose text is never part of an article.
SKIPPED = RAW | {"head", "form", "select", "option", "button", "svg", "annotation", "annotation-xml", "canvas", "template", "object", "audio", "video", "map", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag of the key closes an open element of the value, up to the nearest of SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "menu", "div", "article", "section", "body", "html"}

#: Quotes count only where a value begins; elsewhere they are characters like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: Words in classes, ids and roles that mark boilerplate.
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising alert banner billboard breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer disqus feedback foot footer form gdpr head header login logo masthead menu menubar meta modal nav navbar navigation newsletter notice notification pager pagination popover popup promo promoted promotion rail recommended related replies reply reviews search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar trending widget widgets".split())
#: Those of them that have other senses in company, as in share-price or related-work.
UNSURE_NAMES = frozenset("alert banner byline foot form head logo meta notice rail recommended related replies reply reviews search share sharing tags trending".split())
#: Words that say where or what kind of box it is: beside one of BAD_NAMES they leave it as strong, while any other word takes half of it, or most if it is unsure.
PLAIN_NAMES = frozenset("aside area article articles bar block body bottom box btn button buttons card cell col column container content footer fixed global group header holder icon icons inner item items left line link links list main module new news outer page panel post posts primary right row secondary section site slot stories story sub text top unit wrap wrapper".split())
GOOD_NAMES = frozenset("article body content entry main post story text".split())
#: An article element is boilerplate by these names only.
NO_ARTICLE = frozenset("ad ads advert comment comments promo related reply replies teaser".split())
#: Class names like has-sidebar or comments-open say what else a page has.
ABOUT = re.compile(r"^(?:has|with|without|no|is|js)[-_]|[-_](?:open|closed|enabled|disabled)$")
BAD_TAGS = frozenset("nav footer aside menu header".split())
GOOD_TAGS = frozenset("article main".split())
#: What speaks for an article, against 1 for what speaks against it.
GOOD = 0.2
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. A path is a tuple of (tag, sign of ``named``, number) of elements; white space in a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, float, int]] = []
    texts: list[str] = []
    linked = 0
    skip = 0  # depth of the outermost skipped element, or 0
    in_link = 0
    serial = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = SPACE.sub(" ", "".join(texts)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), tuple(e for e in stack if e[0] in BLOCK or e[1])))
            texts.clear()
        linked = 0

    def shut(depth: int) -> None:
        """Closes open elements down to ``depth`` of them."""
        nonlocal skip, in_link
        if any(e[0] in BLOCK for e in stack[depth:]):
            flush()
        in_link -= sum(e[0] == "a" for e in stack[depth:])
        del stack[depth:]
        if skip > depth:
            skip = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = entities.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if in_link:
                linked += len(text.strip())

    pos = 0
    while True:
        m = TAG.search(page, pos)
        if m is None:
            put(page[pos:])
            break
        put(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                put(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None:
                if tag in BLOCK and not skip:
                    flush()
                continue
            # A stray end of an inline element doesn't close the blocks around it.
            if tag in BLOCK or tag in SKIPPED or not any(e[0] in BLOCK for e in stack[depth:]):
                shut(depth)
            continue
        attributes = m[3]
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr") and not skip:
                texts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag == "body" or (tag in BLOCK and skip and any(e[0] == "head" for e in stack)):
            # A head that was never closed ends where the body begins.
            depth = next((i for i, e in enumerate(stack) if e[0] == "head"), None)
            if depth is not None:
                shut(depth)
        if tag in BLOCK:
            if tag != "body" and not skip:
                flush()
            # A block ends an open paragraph, and inline elements left open in it.
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if depth is not None and not any(e[0] in BLOCK for e in stack[depth + 1 :]):
                shut(depth)
        if tag in CLOSES:
            depth = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    depth = i
                elif stack[i][0] in SCOPE:
                    break
            if depth is not None:
                shut(depth)
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        stack.append((tag, named(tag, attributes), serial))
        if tag == "a":
            in_link += 1
        if not skip and (tag in SKIPPED or (attributes and HIDDEN.search(attributes))):
            if tag in BLOCK:
                flush()
            skip = len(stack)
    flush()
    return out


def named(tag: str, attributes: str) -> float:
    """From -1, an element's tag and names say boilerplate, to GOOD, they say article; 0: nothing. A name of which half the words say boilerplate counts half, or an eighth if they are unsure ones."""
    if tag in ("html", "body"):
        return 0.0
    if tag in BAD_TAGS:
        return -1.0
    bad_words = NO_ARTICLE if tag in GOOD_TAGS else BAD_NAMES
    worst, good = 0.0, tag in GOOD_TAGS
    if "=" in attributes:
        for n in NAMES.finditer(attributes):
            for token in (n[1] or n[2] or n[3] or "").split():
                if ABOUT.search(token.lower()):
                    continue
                words = [w.lower() for w in WORDS.findall(token)]
                bad = sum(w in bad_words for w in words)
                if bad:
                    sure = any(w in bad_words and w not in UNSURE_NAMES for w in words)
                    worst = max(worst, (bad / sum(w in bad_words or w not in PLAIN_NAMES for w in words)) ** (1 if sure else 3))
                good = good or any(w in GOOD_NAMES for w in words)
    return -worst if worst else GOOD if good else 0.0


def mark(path: tuple) -> float:
    """What a path's elements say together: the worst of them, made up for by a good one inside it unless it is nearly sure. A header inside an article is the article's."""
    worst = best = 0.0
    article = False
    for tag, sign, _ in path:
        if sign < 0 and not (tag == "header" and article):
            if sign <= worst:
                worst, best = sign, 0.0
        elif sign > 0:
            article = article or tag in GOOD_TAGS
            best = sign
    return worst if worst <= -0.9 else worst + best


#: What short lines around an article hold.
MARKS = re.compile(r"©|copyright|all rights reserved", re.I)
FEATURES = 10


def features(found: list[Block]) -> np.ndarray:
    """Looks of each block by itself, without any name: FEATURES numbers near 0 to 1."""
    out = np.zeros((len(found), FEATURES), np.float64)
    n = max(1, len(found))
    for i, b in enumerate(found):
        own = b.path[-1][0] if b.path else ""
        words = b.text.count(" ") + 1
        out[i] = (1, min(1.0, math.log1p(len(b.text)) / 7), b.linked / len(b.text), b.text[-1] in ".!?…。！？»\"”", words >= 8, own in HEADS, i / n, b.text.count(",") / words, len(b.text) < 160 and bool(MARKS.search(b.text)), min(len(b.path), 20) / 20)
    return out


#: Weights before any fit, in the order of features(): what the fit starts from and is drawn towards.
PRIOR = np.array([-2.5, 4.0, -5.0, 1.0, 1.0, 1.5, 0.0, 0.5, -3.0, 0.0])


def weak_labels(found: list[Block]) -> np.ndarray:
    """By marks alone, which the classifier does not see: 1 inside an article, 0 where boilerplate is sure, else -1."""
    marks = marks_of(found)
    inside = np.array([any(e[0] in GOOD_TAGS for e in b.path) for b in found], bool)
    return np.where(marks <= -0.9, 0, np.where((marks > 0) & inside, 1, -1)).astype(np.int8)


def fit(x: np.ndarray, y: np.ndarray, pull: float = 20.0, rounds: int = 20) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR with strength ``pull``; each class counts the same."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) * min(len(y), 2000) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + pull * (w - PRIOR)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def edges(found: list[Block], marks: np.ndarray, smooth: float = SMOOTH, hub: float = HUB) -> list[tuple[int, int, float]]:
    """Ties of blocks: each to the next one, to the last block before it under each of its two nearest parents, and to the block with most text, of those that aren't surely boilerplate by their ``marks``, under each of the two elements around it. A heading goes with what follows it rather than with what is before it; ties into what is surely boilerplate are half as strong."""
    out = []
    last: dict[int, int] = {}
    largest: dict[int, int] = {}
    sizes = [len(b.text) - b.linked if m > -0.9 else -1 for b, m in zip(found, marks.tolist())]
    for i, b in enumerate(found):
        mine = [e[2] for e in b.path]
        if i:
            theirs = [e[2] for e in found[i - 1].path]
            shared = sum(1 for a, c in zip(mine, theirs) if a == c)
            head, after = (bool(x.path) and x.path[-1][0] in HEADS for x in (b, found[i - 1]))
            out.append((i - 1, i, smooth * (0.25 if head else 1.5 if after else 1.0) * 0.5 ** max(0, max(len(mine), len(theirs)) - shared - 1)))
        for up, e in enumerate(mine[::-1][:2]):
            j = last.get(e)
            if j is not None and j != i - 1 and b.path[-1][0] not in HEADS:
                out.append((j, i, smooth * 0.5 ** (up + 1)))
            last[e] = i
        for e in mine[-3:-1]:
            if e not in largest or sizes[i] > sizes[largest[e]]:
                largest[e] = i
    for i, b in enumerate(found):
        for up, (tag, _, e) in enumerate(b.path[-3:-1][::-1]):
            # Blocks under the body are whatever the page has.
            if largest[e] != i and tag not in ("body", "html"):
                out.append((i, largest[e], hub * 0.5**up))
    sure = (marks <= -0.9).tolist()
    return [(i, j, c * (0.5 if sure[i] != sure[j] else 1.0)) for i, j, c in out]


def min_cut(costs: np.ndarray, ties: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of least cost: ``costs`` (block, 2) of calling it boilerplate, content. By Dinic's maximum flow; True: content, on the source's side."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, (boiler, content) in enumerate(costs.tolist()):
        # What both terminals share flows at once.
        both = min(boiler, content)
        if boiler > both:
            edge(source, i, boiler - both, 0.0)
        if content > both:
            edge(i, sink, content - both, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]], bool)
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                least = min(cap[e] for e in path)
                back = len(path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                    if cap[e] <= tiny and k < back:
                        back = k
                node = to[path[back] ^ 1]
                del path[back:]
                continue
            while at[node] < len(out[node]):
                e = out[node][at[node]]
                if cap[e] > tiny and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(out[node]):
                path.append(out[node][at[node]])
                node = to[path[-1]]
            elif node == source:
                break
            else:
                level[node] = -1
                node = to[path.pop() ^ 1]


def marks_of(found: list[Block]) -> np.ndarray:
    return np.array([mark(b.path) for b in found], np.float64)


def leanings(found: list[Block], weights: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How much more each block costs as boilerplate than as content, before the cut."""
    return np.clip(features(found) @ weights + MARK_COST * marks, -MOST_COST, MOST_COST)


def content(found: list[Block], weights: np.ndarray = PRIOR) -> np.ndarray:
    """Whether each block is content, by the minimum cut."""
    if not found:
        return np.zeros(0, bool)
    marks = marks_of(found)
    z = leanings(found, weights, marks)
    return min_cut(np.stack((np.logaddexp(0, z), np.logaddexp(0, -z)), axis=1), edges(found, marks))


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, c in zip(found, content(found, weights)) if c)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Weights fitted on weakly labelled blocks of about ``most`` pages, or all; 64 blocks a page at most, which is what the driver gets of them: FEATURES numbers each."""
    rows = pages.where("html is not null").select("page_id", "url", F.col("html").cast("string").alias("html"))
    # Only pages that are equal in all three can be drawn together; the limit is for those.
    rows = sampled(rows, most / max(1, rows.select("page_id").count()), "page_id", "url", F.col("html")).limit(4 * most)

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            xs, ys = [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                # At most 64 blocks of a page, evenly spaced: long pages don't outweigh the others.
                every = -(-len(found) // 64) or 1
                y = weak_labels(found)[::every]
                xs.append(features(found)[::every][y >= 0])
                ys.append(y[y >= 0])
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y.astype(np.int32))], names=["x", "y"])

    # Equal looks are counted, so the order of rows has no say.
    got = rows.select("html").mapInArrow(looks, "x binary, y int").groupBy("x", "y").count().toPandas().sort_values(["y", "x"])
    if not len(got):
        return PRIOR
    n = got["count"].to_numpy()
    return fit(np.repeat(np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, FEATURES), n, axis=0), np.repeat(got["y"].to_numpy(), n))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of html.

    Null html, and a page without any content block, give an empty text. Pages
    are independent of each other, so repeated rows give equal texts, and an
    empty table gives no rows. Existing columns text and n_chars are replaced.
    """
    lean(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page, weights) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in range(len(kept))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f"c{i}" for i in range(len(kept))] + ["text", "n_chars"])

    wide = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col("html").cast("string").alias("html"))
    schema = wide.drop("html").schema.add("text", "string").add("n_chars", "long")
    return wide.mapInArrow(trimmed(run), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")
