"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read tag by tag into blocks: text between two block-level tags, with white space turned into
one space; ``<br>`` is white space. What of a line is marked as hidden or as no article text is a block of
its own. A block knows its words and the share of them inside links, and the tree sees these of the
blocks before and after it, too; besides, whether the block is a heading, stands in a structural element
that is no article text (menu, footer, form and the like), how far a class, id or role says so, and whether
it stands in the article element or one named like it. The tree is trained here by Gini impurity on PAGES,
a small table of page sketches with labelled blocks; the neighbours of a block are those of its page.

Defined cases: a null or empty html, or one without main text, gives the empty text. A page cut off
inside a tag, a comment or an element ends there. Rows without page_id or url keep their nulls. Repeated
rows give repeated results, an empty table none. A leaf of the tree with as many blocks of either label
counts as main text. Extra columns are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bpe import parted

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "structure", "away", "inside", "has_article", "heading")
#: Sketches of pages. A line stands for one or more blocks of a kind: label (1 is main text), how many, words, links in
#: hundredths of the words, structure, away, inside, heading; a value or a range. Words are drawn evenly by
#: logarithm, the rest evenly.
PAGES = """
article element, menu, advert, footer
0 0-1 1-10 0-100 1 0 0 0-1
0 0-9 1-4 100 1 0 0 0
0 0-2 2-60 0-30 0 2 0 0
1 0-1 1-14 0-10 0 0 1 1
1 1-9 4-200 0-12 0 0 1 0
0 0-3 2-30 0-60 1 0 0 0

article alone
1 0-1 1-14 0-20 0 0-1 1 1
1 0-3 1-200 0-40 0 0 1 0
1 1-2 1-200 0-20 0 0 1 0

article with lists, notes and short lines
0 0-8 1-3 100 0-1 0-2 0 0
1 0-1 2-12 0 0 0 1 1
1 0-4 1-12 0-30 0 0 1 0
1 1-3 20-150 0-25 0 0 1 0
0 0-2 2-40 0-40 0 2 1 0
1 0-1 1-8 0 0 0 1 1
1 0-7 1-15 0-40 0 0 1 0
1 0-2 5-40 40-70 0 0 1 0
1 0-3 15-120 0-20 0 0 1 0
0 0-5 1-14 81-100 0 0-1 1 0
0 0-4 1-20 0-100 1 0 0 0

article between adverts and notices
0 0-2 1-60 0-100 0 2 0 0-1
1 0-1 1-14 0-10 0 0 1 1
1 1-2 2-150 0-20 0 0 1 0
0 1-2 1-40 0-60 0 2 1 0
1 1-2 2-150 0-20 0 0 1 0
0 0-2 1-40 0-60 0 2 1 0
1 0-2 2-150 0-20 0 0 1 0
0 0-3 1-60 0-100 0 2 0 0

article with comments, share lines and related links
1 0-1 2-12 0 0 0-1 1 1
1 2-8 10-160 0-15 0 0-1 1 0
0 0-3 1-4 80-100 0 1-2 1 0
0 0-1 1-4 0 0 2 1 1
0 2-6 3-120 0-20 0 2 1 0
0 3-6 2-12 85-100 0 0-1 1 0
0 0-5 1-3 100 1 0 0 0

article where a line is one link
1 1-3 20-150 0-10 0 0 1 0
1 1 3-20 81-100 0 0 1 0
1 1-3 20-150 0-10 0 0 1 0
0 0-4 1-20 0-100 1 0 0 0

article beside blocks without a name
0 0-6 1-4 60-100 0 0 0 0
0 0-3 3-60 0-40 0 0 0 0-1
1 0-1 2-12 0 0 0 1 1
1 1-6 5-160 0-15 0 0 1 0
0 0-4 3-60 0-60 0 0 0 0
0 0-2 3-25 0-30 0 0 0 0

page without article element, paragraphs
0 0-7 1-4 100 0 0 0 0
1 0-1 2-12 0 0 0 0 1
1 2-9 20-200 0-25 0 0 0 0
1 0-1 2-9 0 0 0 0 1
1 1-4 18-200 0-25 0 0 0 0
0 0-6 1-8 70-100 0 0 0 0
0 0-2 2-9 0-30 0 0 0 0

page without article element, short lines between long ones
0 0-5 1-3 90-100 0-1 0 0 0
1 1-3 25-200 0-20 0 0 0 0
1 1 1-17 0-20 0 0 0 0
1 1-3 25-200 0-20 0 0 0 0
1 1 1-12 0-15 0 0 0 0
1 1-2 25-200 0-20 0 0 0 0
0 0-7 1-9 60-100 0 0 0 0

page without article element, named parts
0 0-6 1-4 100 0 2 0 0
1 0-1 2-12 0 0 0 0 1
1 1-8 20-200 0-25 0 0-1 0 0
0 0-4 4-90 0-40 0 2 0 0
0 0-6 2-12 60-100 0 0-2 0 0
0 0-2 3-30 0-60 1 0 0 0

list of links with teasers
0 0-6 1-4 100 0 0-2 0 0-1
0 6-16 2-16 45-100 0 0-1 0 0-1
0 0-3 1-9 0-100 0 0-2 0 0

short lines only
0 1-9 1-8 0-100 0 0 0 0
0 0-2 1-8 0 0 0 0 1
"""
#: Pages that are drawn of each sketch.
SAMPLES = 120
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|head|svg|math|iframe|object|canvas|audio|video|textarea|select"
#: Elements that hold no article text.
STRUCTURE = frozenset("nav header footer aside form menu dialog button fieldset address".split())
#: Elements that run within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end with their tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is no article text, and what is.
AWAY = frozenset("ad ads adv advert adverts advertisement advertising banner sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended recommendations promo promotion sponsor sponsored subscribe subscription newsletter signup login widget widgets pagination pager toolbar complementary contentinfo search rail".split())
HERE = frozenset("article content main post entry story body text".split())

#: Words that, with a name of the article, mark its head; and words before a name that speak of another element.
HEAD, ABOUT = frozenset(["header"]), frozenset("has with no is without".split())
#: Elements that end where their like begins.
IMPLIED = frozenset("p li dt dd tr td th option".split())

_SILENT = frozenset(SILENT.split("|"))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*))?|[\s/]+)*+[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _SILENT}
_PAIR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)


def _name(name: str, lone: bool) -> tuple[int, bool]:
    """What one name says: 2 if most of it names something away from the article, 1 if some of it does; and
    whether it names the article. ``lone``: only a name that is one word counts."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[0] in ABOUT or lone and len(parts) > 1:
        return 0, False
    away, here = [p for p in parts if p in AWAY], any(p in HERE for p in parts)
    if not away:
        return 0, here and not lone
    return (1 if len(away) * 2 < len(parts) or here and set(away) <= HEAD else 2), False


@lru_cache(maxsize=5000)
def says(attributes: str, lone: bool = False) -> tuple[int, bool]:
    """(how far the attributes of a tag lead away from the article, 0 to 2; whether they name it)."""
    away, here = 0, False
    for m in _PAIR.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return 2, False
        if name in ("class", "id", "role"):
            for x in value.split():
                far, near = _name(x, lone)
                away, here = max(away, far), here or near
    return (min(away, 1), True) if here else (away, False)


def blocks(page: str | None) -> list[tuple[str, int, int, bool, int, bool, bool]]:
    """(text, words, words in links, structure, away, inside, heading) of each block, in page order."""
    page = page or ""
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # tag, structure, away, inside
    opened: Counter[str] = Counter()
    aside: list = []  # an inline element away from the article: its tag, how often it is open, the stack's height
    side: list[tuple[str, bool]] = []  # its text
    in_link, heading, at = 0, False, 0

    def flush(found: list[tuple[str, bool]], away: int) -> None:
        text = " ".join(html.unescape("".join(t for t, _ in found)).split())
        if text:
            linked = sum(len(html.unescape(t).split()) for t, k in found if k)
            _, structure, far, inside = stack[-1]
            out.append((text, len(text.split()), linked, structure, max(far, away), inside, heading))
        found.clear()

    def pop(to: int) -> None:
        for tag, *_ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]
        if aside and len(stack) < aside[2]:
            aside.clear()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            (side if aside else parts).append((text, bool(in_link)))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                (side if aside else parts).append((html.escape(m[0][9:].removesuffix("]]>")), bool(in_link)))
            continue
        tag, closing, ends = m[2].lower(), bool(m[1]), m[3].endswith("/")
        if tag in _SILENT:
            if tag not in INLINE:
                flush(parts, 0)
                flush(side, 2)
            if not closing and not ends:
                end = _END[tag].search(page, at)
                if end is None and tag == "head":
                    continue
                at = end.end() if end else len(page)
            continue
        away, here = says(m[3], tag == "article") if not closing and m[3] and tag not in ("body", "main") and _TELLS.search(m[3]) else (0, False)
        if tag in INLINE:
            if tag == "br":
                (side if aside else parts).append((" ", bool(in_link)))
            elif tag in VOID or ends:
                continue
            elif aside and tag == aside[0]:
                aside[1] += -1 if closing else 1
                if not aside[1]:
                    aside.clear()
                    parts.append((" ", False))
                    side.append((" ", False))
            elif away == 2 and not aside:
                aside[:] = [tag, 1, len(stack)]
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        flush(parts, 0)
        flush(side, 2)
        in_link = 0
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in VOID or tag == "html":
            continue
        if closing:
            if opened[tag]:
                pop(max(k for k in range(len(stack)) if stack[k][0] == tag))
        elif not ends:
            if stack[-1][0] == "p" or tag in IMPLIED and stack[-1][0] == tag:
                pop(len(stack) - 1)
            _, structure, far, inside = stack[-1]
            structure = structure or (tag in STRUCTURE and not (tag == "header" and inside))
            stack.append((tag, structure, max(far, away), inside or here or tag in ("article", "main")))
            opened[tag] += 1
    flush(parts, 0)
    flush(side, 2)
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = [b[1] for b in found]
    x[:, 1] = [100 * b[2] // max(1, b[1]) for b in found]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    for k, i in ((6, 3), (7, 4), (8, 5), (10, 6)):
        x[:, k] = [b[i] for b in found]
    x[:, 9] = x[:, 8].any()
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | float:
    """A decision tree: (feature, threshold, where at most, where over) or the share of positives."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (2.0, 0, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= cut
            p, q, w = y[low].mean(), y[~low].mean(), low.mean()
            best = min(best, (w * p * (1 - p) + (1 - w) * q * (1 - q), k, float(cut)))
    _, k, cut = best
    low = x[:, k] <= cut
    if low.all() or not low.any():
        return float(y.mean())
    return (k, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def table() -> tuple[np.ndarray, np.ndarray]:
    """PAGES drawn out: features and labels of the blocks, whose neighbours are those of their page."""
    random, rows, labels = np.random.default_rng(0), [], []
    for sketch in PAGES.strip().split("\n\n"):
        lines = [[[int(v) for v in (x.split("-") * 2)[:2]] for x in line.split()] for line in sketch.splitlines()[1:]]
        for _ in range(SAMPLES):
            found = []
            for label, times, words, links, *rest in lines:
                for _ in range(random.integers(times[0], times[1] + 1)):
                    n = int(np.exp(random.uniform(np.log(words[0]), np.log(words[1] + 1))))
                    share = random.integers(links[0], links[1] + 1)
                    found.append(("", n, -(-share * n // 100), *(int(random.integers(low, high + 1)) for low, high in rest)))
                    labels.append(label[0])
            rows.append(features(found))
    return np.concatenate(rows), np.array(labels, float)


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    return grow(*table())


def classify(node: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node >= 0.5)
    k, cut, low, high = node
    out, small = np.empty(len(x), bool), x[:, k] <= cut
    out[small], out[~small] = classify(low, x[small]), classify(high, x[~small])
    return out


def main_text(page: str | None, trained: tuple | float | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, classify(trained or tree(), features(found)).tolist(), strict=True) if keep)


def _extracted(trained: tuple | float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parted(whole, "html"):
            texts = [main_text(p.as_py(), trained) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extracted, tree()), "page_id long, url string, text string, n_chars long")
