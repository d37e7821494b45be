"""Main-text extraction from HTML by shallow text features.

A page becomes a flat list of text blocks (text between block-level tags, in page order). Each
block has a word count, a link density, the hint of the elements around it (an article or main
element; a menu, footer, sidebar, advert, form, comment list...; neither) and the word count and
link density of its two neighbours. A decision tree, trained on a small labelled table, says
which blocks belong to the article.

The labelled table is :func:`labelled_blocks`: ``pages`` small page plans of different layouts, made by
a rule from a seed (``pages`` bounds it). In a third of them the hints are hidden, so the tree also
learns to tell blocks by their words, links and neighbours alone; in a twelfth all hints are wrongly against. Any other labelled rows of
the same form may be passed instead.

Defined cases: null or empty html, and a page without a content block, give an empty text;
unclosed tags, comments, quotes and cut-off references are read as far as they go; pages of any
length are read whole; repeated rows get equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import arrow_map

# Element names by their part in a page.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes object svg math head select button".split())
RAW_TEXT = frozenset("script style textarea title".split())  # without an end tag these last to the end of the page
FLAT = frozenset("button select head".split())  # not within themselves
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr br picture source input meta link""".split())
CONTAINERS = frozenset("""article aside body center details dialog div dl fieldset figure footer form header html li main menu nav ol
section table tbody td tfoot th thead tr ul blockquote""".split())
FLOW = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre address dt dd hr".split())
AGAINST_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
FOR_TAGS = frozenset("article main".split())
# Words of class, id and role names.
AGAINST = frozenset("""nav navbar navigation navigational menu menubar breadcrumb breadcrumbs pagination pager footer foot copyright legal
contentinfo header masthead banner topbar sidebar side rail complementary widget ad ads advert advertisement adsense advertising sponsor
sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social comment comments
disqus reply replies respond discussion related recommended recommendations newsletter subscribe subscription signup login search form
toolbar tags skip hidden""".split())
FOR = frozenset("article main content post entry story articlebody".split())
NEGATIONS = frozenset("with has no without".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
FEATURES = ("hint", "words", "links", "words_before", "links_before", "words_after", "links_after")


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    hint: int  # 1: inside an article, -1: inside a menu, footer, advert..., 0: neither


def hint_of(name: str, rest: str, parent: int) -> int:
    """The hint below an element: what stands against an article is inherited, except by a main element.

    A word against an article outweighs on its own; beside a word for one in the same attribute neither counts,
    and on an article or main element it is not heard. In "post-comments" the last word decides.
    """
    if HIDDEN.search(rest) or name in AGAINST_TAGS or (parent < 0 and name != "main"):
        return -1
    if name in FOR_TAGS:
        return 1
    if name == "header":
        return parent if parent > 0 else -1
    found = 0
    if name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(rest):
            good = bad = False
            before = ""
            for token in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in NAME_PART.findall(token)]
                for part in parts:
                    bad |= part in AGAINST and before not in NEGATIONS
                    before = part
                good |= any(x in FOR for x in parts) and parts[-1] not in AGAINST
            if bad:
                return 0 if good else -1
            if good or any(x.lower() in FOR for x in NAME_PART.findall(m[2] or m[3] or m[4] or "")):
                found = 1
    return found or parent


def raw_end(page: str, at: int, name: str, around: set[str], last_end: dict[str, int]) -> int:
    """Where the page goes on after the start tag of a RAW element: behind its end tag.

    Without one, RAW_TEXT lasts to the end of the page, the others to the next FLOW tag. Script and the like hide
    the tags in them. The end tag must come before the end of an element ``around`` and, for FLAT, the next of its kind.
    """
    if name not in last_end:
        last_end[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}\b", page, re.I)), default=-1)
    if name in RAW_TEXT or name in ("xmp", "noembed", "noframes", "iframe"):
        stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at) if last_end[name] >= at else None
        if stop or name in RAW_TEXT:
            return stop.end() if stop else len(page)
    opened, inner, flow, seen = [], 0, None, at
    while m := TAG.search(page, seen):
        if name == "head" and flow is None and page[seen:m.start()].strip():
            flow = seen  # text: a head without end tag ends here
        seen = m.end()
        tag = m["name"] or m["name2"]
        if tag is None:
            continue
        tag = tag.lower()
        end, rest = (m["end"], m["rest"]) if m["name"] else (m["end2"], m["rest2"])
        if tag == name:
            if end:
                if not inner:
                    return m.end()
                inner -= 1
                continue
            if name in FLAT:
                return m.start() if flow is None else flow
            inner += not rest.endswith("/")
        elif tag in RAW_TEXT and not end and not rest.endswith("/"):
            seen = raw_end(page, seen, tag, around, last_end)
        elif tag in FLOW:
            if name == "head":
                return m.start() if flow is None else flow
            flow = m.start() if flow is None else flow
            if tag in CONTAINERS and not rest.endswith("/"):
                if not end:
                    opened.append(tag)
                elif tag in opened:
                    while opened.pop() != tag:
                        pass
                elif tag in around:
                    return flow
        if flow is not None and last_end[name] < seen and name != "head":
            return flow
    return len(page) if flow is None else flow


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []  # pieces of the open block, and whether inside a link
    stack: list[tuple[str, int]] = []
    hint, links, at = 0, 0, 0
    last_end: dict[str, int] = {}

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join([p for p, _ in parts]).split())
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), hint))
            parts = []

    while True:
        m = TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            parts.append((html.unescape(piece), links > 0))
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        end, rest = (m["end"], m["rest"]) if m["name"] else (m["end2"], m["rest2"])
        if name in RAW:
            if not end and not rest.endswith("/"):
                at = raw_end(page, at, name, {n for n, _ in stack}, last_end)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if end else 1
            elif name == "br":
                parts.append((" ", False))
            continue
        close()
        if name in CONTAINERS and not rest.endswith("/"):
            links = 0
            if not end:
                stack.append((name, hint))
                hint = hint_of(name, rest, hint)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        hint = stack[k][1]
                        del stack[k:]
                        break
    close()
    return out


def features(words: np.ndarray, linked: np.ndarray, hint: np.ndarray, page: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each block; ``page`` numbers the blocks' pages, whose blocks are in order."""
    density = linked / np.maximum(words, 1)
    out = np.zeros((len(words), len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 2] = hint, words, density
    same = page[1:] == page[:-1]
    out[1:, 3], out[1:, 4] = words[:-1] * same, density[:-1] * same
    out[:-1, 5], out[:-1, 6] = words[1:] * same, density[1:] * same
    return out


def labelled_blocks(pages: int = 2000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: feature rows and whether each is content, from ``pages`` page plans."""
    rng = np.random.default_rng(seed)
    some = lambda a, b: int(rng.integers(a, b))
    x, y = [], []
    for page in range(pages):
        rows = []  # words, linked words, hint, content
        for w in [some(2, 15)] if rng.random() < .4 else rng.integers(1, 4, some(3, 10)).tolist():  # menu: one line or a list
            rows.append((w, w, -1, 0))
        for _ in range(some(0, 3) if rng.random() < .5 else 0):  # notice, advert
            rows.append((some(3, 15), some(0, 3) if rng.random() < .5 else 0, -1, 0))
        brief = rng.random() < .25  # an article of a few short lines
        if not brief and rng.random() < .7:
            rows.append((some(2, 14), 0, 1, 1))  # title
        for k in range(some(1, 4) if brief else some(1, 14)):
            kind = rng.random()
            w = some(1, 7) if brief else some(1, 12) if kind < .25 else some(12, 220)
            rows.append((w, some(0, max(w // 5, 1)), 1, 1))
            if kind > .95:  # a line that is one link between paragraphs
                w = some(2, 8)
                rows += [(w, w, 1, 1), (some(20, 120), 0, 1, 1)]
        if rng.random() < .3:  # link list after the article
            for _ in range(some(4, 9)):
                w = some(1, 6)
                rows.append((w, w, -1, 0))
        if rng.random() < .6:  # else the page ends with its article
            for _ in range(some(0, 4)):  # readers' comments, sidebar
                rows.append((some(4, 60), some(0, 2), -1, 0))
            for _ in range(some(1, 4)):  # footer
                w = some(2, 14)
                rows.append((w, w if rng.random() < .4 else 0, -1, 0))
        words, linked, hint, label = (np.array(c, float) for c in zip(*rows))
        if page % 3 == 0:
            hint = hint * 0
                # without hints, comments and notices look like short paragraphs: only links and a page's last line teach
            sure = (label == 1) | (linked > words / 2) | (np.arange(len(words)) == len(words) - 1)
        elif page % 12 == 1:  # a wrong word around the whole page
            hint = hint * 0 - 1
            sure = (label == 0) | (words > 60)
        else:
            sure = np.ones(len(words), bool)
        x.append(features(words, np.minimum(linked, words), hint, np.zeros(len(words)))[sure])
        y.append(label[sure].astype(bool))
    return np.concatenate(x), np.concatenate(y)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, leaf: int = 2):
    """A decision tree by Gini impurity: ``(feature, limit, low, high)`` or a bool."""
    majority = bool(y.mean() >= 0.5) if len(y) else False
    if depth == 0 or len(y) < 2 * leaf or y.all() or not y.any():
        return majority
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order].astype(float)
        n = np.arange(1, len(t))
        left = np.cumsum(t)[:-1]
        right = t.sum() - left
        cost = 2 * left * (1 - left / n) + 2 * right * (1 - right / (len(t) - n))
        cost[(v[1:] == v[:-1]) | (n < leaf) | (len(t) - n < leaf)] = np.inf
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (cost[i], f, float(v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return majority
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], train_tree(x[low], y[low], depth - 1, leaf), train_tree(x[~low], y[~low], depth - 1, leaf))


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Whether each row is content."""
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    feature, limit, low, high = tree
    out = np.zeros(len(x), bool)
    below = x[:, feature] <= limit
    if below.any():
        out[below] = classify(low, x[below])
    if not below.all():
        out[~below] = classify(high, x[~below])
    return out


def main_texts(pages: list[str | None], tree) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    flat = [b for bs in found for b in bs]
    if not flat:
        return [""] * len(pages)
    words, linked, hint = (np.array(c, float) for c in zip(*[(b.words, b.linked, b.hint) for b in flat]))
    page = np.repeat(np.arange(len(pages)), [len(bs) for bs in found])
    keep = iter(classify(tree, features(words, linked, hint, page)).tolist())
    return ["\n".join([b.text for b in bs if next(keep)]) for bs in found]


def extract(pages: DataFrame, labelled: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``; one narrow pass over the html."""
    tree = train_tree(*(labelled_blocks() if labelled is None else labelled))
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column("html").to_pylist(), tree)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(src, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
