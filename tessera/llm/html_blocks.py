"""HTML main text from flat text blocks and a decision tree.

A page is read once, tag by tag, into flat text blocks: the text between two
block-level tags.  A block knows its number of words, its link density (share of words
inside links), those of the block before and after it, and what its open elements are for.
A decision tree calls each block text or boilerplate; text blocks are joined in page order.  It is grown on a
labelled table of some two thousand blocks, which ``labelled`` reads off pages that a rule builds: with and without
elements and words that tell what is the article and what is furniture, with paragraphs and boilerplate of many sizes.
Where nothing tells them apart, sizes and link densities of a block and its neighbours decide.

Defined results: a null or empty page has an empty text; a page that breaks off
inside a tag loses that tag alone; unclosed elements end with their parent; text in
no block-level element is a block like any other; repeated rows are extracted each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose start and end break the flow of text (block level).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page.
OPAQUE = frozenset("head iframe script select style svg template textarea title".split())
#: Elements whose content the parser takes as raw text up to the end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are page furniture, and elements that hold an article.
FURNITURE = frozenset("aside button dialog footer form menu nav search".split())
CONTENT = frozenset("article main".split())
#: Words of class, id and role attributes that tell what an element is for.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())

#: A tag's marks: by words that only describe a layout, by other words, and by what nothing inside takes back.
LAYOUT, WORDED, LASTING = 1, 2, 3
LAYOUT_WORDS = frozenset("ad ads header menu nav navbar share sharing sidebar social toolbar widget".split())
#: Words that describe an article's part as often as furniture, if an article's word comes last or stands alone beside them.
DESCRIBING = LAYOUT_WORDS | {"search"}
#: Words for texts beside the article, whatever elements they use, and words of an article's own header.
OTHERS = frozenset("comment comments disqus related replies reply respond".split())
HEADED = frozenset("article entry post story".split())

# a quote is one only directly after "=" and if it is closed
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(>|\Z))", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v \u0085  -     　]+")
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A flat text block: its text, words, words in links and what encloses it."""

    text: str
    words: int
    linked: int
    furniture: bool
    content: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _mark(tag: str, value: str, in_content: bool) -> int:
    """How strongly the words of an attribute mark an element as page furniture."""
    mark = 0
    tokens = value.split()
    of_article = in_content and any((_PART.findall(t) or [""])[-1] in CONTENT_WORDS for t in tokens)
    for token in tokens:
        parts = set(_PART.findall(token))
        found = parts & FURNITURE_WORDS
        if of_article and token not in FURNITURE_WORDS and found <= DESCRIBING:
            continue
        if found == {"header"} and (in_content or parts & HEADED):
            continue  # an article's own header
        if not found or tag in CONTENT and token not in FURNITURE_WORDS:
            continue
        if found & OTHERS:
            mark = max(mark, LASTING)
        else:
            mark = max(mark, LAYOUT if token not in FURNITURE_WORDS and found <= LAYOUT_WORDS else WORDED)
    return mark


def _purpose(tag: str, attributes: str, in_content: bool) -> tuple[int, bool, bool]:
    """How strongly an element is marked as page furniture, whether it is an article's, and whether it is not shown."""
    mark = LASTING if tag in FURNITURE else 0
    content, unseen, headed = tag in CONTENT, False, in_content
    if attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "style":
                unseen |= "display:none" in value.replace(" ", "")
            elif name == "hidden":
                unseen = True
            elif name == "aria-hidden":
                unseen |= value == "true"
            elif tag not in ("html", "body"):
                own = _mark(tag, value, in_content)
                parts = set(_PART.findall(value))
                mark = max(mark, own)
                content |= bool(parts & CONTENT_WORDS) and not own
                headed |= "header" in parts and bool(parts & HEADED) and not own
    if tag == "header" and not headed:
        mark = LASTING
    if tag == "noscript" and not in_content:
        mark = max(mark, WORDED)
    return mark, content, unseen


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []  # text, in a link
    # open elements: tag, mark as furniture, content, opaque, link
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    heading = False

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join([p for p, _ in parts])).strip()
            if text:
                linked = sum(len(p.split()) for p, on in parts if on)
                words = text.count(" ") + 1
                top = stack[-1]
                out.append(Block(text, words, min(linked, words), top[1] > 0, top[2], heading))
            parts.clear()

    def take(raw: str) -> None:
        if raw and not stack[-1][3]:
            parts.append((entities.unescape(raw) if "&" in raw else raw, stack[-1][4]))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[4] != ">":  # the page breaks off inside a tag
            break
        if tag == "br":
            if parts:
                parts.append((" ", False))
            continue
        if m[1]:
            if tag in BLOCK:
                end_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK:
            end_block()
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        # an unclosed paragraph, list item or cell ends where the next block begins
        if tag in BLOCK:
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                stack.pop()
        top = stack[-1]
        mark, content, unseen = _purpose(tag, m[3], top[2])
        # an article takes back what outer words say, its words what an outer layout says
        taken = WORDED if tag in CONTENT else LAYOUT if content else 0
        outer = top[1] if top[1] > taken else 0
        stack.append((tag, max(outer, mark), top[2] or content, top[3] or unseen or tag in OPAQUE, top[4] or tag == "a"))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stack.pop()
            at = close.end() if close else n
    end_block()
    return out


#: Names of the tree's features, in the order of the labelled table's columns.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "content", "heading", "page_has_content")



#: Words of the labelled pages.
_VOCABULARY = "the of river stone market paper winter north garden letter city boat house early long under between and with from seven open road light".split()


def _page(rng: random.Random, kind: int) -> tuple[str, dict[str, int]]:
    """A page and the labels of its blocks' texts: with marked article and furniture (0), a marked article (1), marked furniture (2) or no marks (3)."""
    labels: dict[str, int] = {}

    def text(n: int, label: int) -> str:
        words = [rng.choice(_VOCABULARY) for _ in range(max(0, n - 1))]
        out = " ".join([f"x{len(labels)}q", *words])
        labels[out] = label
        return out

    def linked(n: int, share: float, label: int) -> str:
        """A text of which a share of the words is in a link."""
        words = text(n, label).split()
        k = round(share * len(words))
        return f"<a href=#>{' '.join(words[:k])}</a> {' '.join(words[k:])}" if k else " ".join(words)

    items = lambda n: "".join(f"<li>{linked(rng.randint(1, 6), 1.0, 0)}</li>" for _ in range(n))
    marked = kind in (0, 2)

    def furniture(tag: str, word: str, inner: str) -> str:
        """Furniture in an element or a class that says so, or in a plain one."""
        if not marked:
            return f"<div>{inner}</div>"
        return rng.choice([f"<{tag}>{inner}</{tag}>", f"<div class='{word}'>{inner}</div>"])

    long = lambda: rng.choice([rng.randint(14, 40), rng.randint(30, 90), rng.randint(60, 160)])
    any_size = lambda: rng.choice([rng.randint(1, 4), rng.randint(3, 14), long(), long()])
    in_article = kind in (0, 1)
    parts = [f"<h1>{text(rng.randint(2, 12), 1)}</h1>"]
    if in_article and rng.random() < 0.4:
        parts.append(f"<p>{text(rng.randint(1, 8), 1)}</p>")
    for k in range(rng.randint(1, 7)):
        if k and rng.random() < 0.2:
            parts.append(f"<h2>{text(rng.randint(1, 8), 1)}</h2>")
        share = rng.choice([0, 0, 0, 0.1, 0.25]) if not in_article else rng.choice([0, 0, 0.1, 0.3, 1.0])
        parts.append(f"<p>{linked(any_size() if in_article else long(), share, 1)}</p>")
        if in_article and rng.random() < 0.15:
            parts.append(f"<aside>{linked(any_size(), rng.choice([0, 1.0]), 0)}</aside>" if rng.random() < 0.5 else f"<div class=share>{linked(rng.randint(1, 9), 1.0, 0)}</div>")
    if in_article and rng.random() < 0.3:
        parts.append("<ul>" + "".join(f"<li>{linked(rng.randint(1, 20), rng.choice([0, 0, 1.0]), 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
    article = "".join(parts)
    if in_article:
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='entry-content'>", "</div>"), ("<div id=content>", "</div>")])
        article = f"{open_}{article}{close}"
    top = [furniture("nav", "menu", f"<ul>{items(rng.randint(2, 7))}</ul>")]
    if rng.random() < 0.6:
        top.insert(rng.randint(0, 1), furniture("header", "masthead", f"<div>{text(rng.randint(1, 6), 0)}</div>"))
    if marked and rng.random() < 0.4:
        top.append(furniture("dialog", "cookie-notice", f"<p>{text(any_size(), 0)}</p><button>{text(1, 0)}</button>"))
    end = [furniture("footer", "footer", f"<p>{linked(rng.randint(3, 11), rng.choice([0, 0.3, 1.0]), 0)}</p><p>{linked(rng.randint(1, 6), 1.0, 0)}</p>")]
    if rng.random() < 0.6:
        end.insert(0, furniture("aside", "sidebar", f"<ul>{items(rng.randint(2, 6))}</ul>"))
    if marked and rng.random() < 0.5:
        end.insert(0, furniture("aside", "comments", "".join(f"<p>{text(any_size(), 0)}</p>" for _ in range(rng.randint(1, 4)))))
    if kind == 1 and rng.random() < 0.5:  # texts of any size beside a marked article
        end.insert(0, "".join(f"<div>{text(any_size(), 0)}</div>" for _ in range(rng.randint(1, 3))))
    return f"<html><body>{''.join(top)}{article}{''.join(end)}</body></html>", labels


def labelled(seed: int = 4, pages: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of blocks, and 1 for text or 0 for boilerplate."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(pages):
        page, known = _page(rng, k % 4)
        found = blocks(page)
        rows += features_of(found)
        labels += [known[b.text] for b in found]
    return np.array(rows, float), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A binary decision tree by Gini impurity: ``(feature, bound, below, above)`` or a label."""
    n, ones = len(y), int(y.sum())
    if depth == 0 or ones in (0, n):
        return int(2 * ones >= n)
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        values, left = x[order, k], np.cumsum(y[order])[:-1]
        at = np.arange(1, n)
        impurity = left - left**2 / at + (ones - left) - (ones - left) ** 2 / (n - at)
        impurity[values[1:] == values[:-1]] = np.inf
        cut = int(impurity.argmin())
        if np.isfinite(impurity[cut]) and (best is None or impurity[cut] < best[0] - 1e-9):
            best = (impurity[cut], k, float(values[cut] + values[cut + 1]) / 2)
    if best is None:
        return int(2 * ones >= n)
    _, k, bound = best
    low = x[:, k] <= bound
    return k, bound, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    """The tree; each worker grows it once, the same everywhere."""
    return grow(*labelled())


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        k, bound, below, above = tree
        tree = below if row[k] <= bound else above
    return tree


def features_of(found: list[Block]) -> list[tuple]:
    """The features of a page's blocks, as ``FEATURES`` names them."""
    has_content = any(b.content and not b.furniture for b in found)
    none = Block("", 0, 0, False, False, False)
    rows = []
    for before, b, after in zip([none, *found], found, [*found[1:], none], strict=False):
        rows.append((b.words, b.density, before.words, before.density, after.words, after.density, b.furniture, b.content, b.heading, has_content))
    return rows


def main_text(page: str | None) -> str:
    """The page's text blocks that the tree calls text, one to a line."""
    found = blocks(page or "")
    grown = tree()
    return "\n".join(b.text for b, row in zip(found, features_of(found), strict=True) if decide(grown, row))


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, the main ``text`` and its length ``n_chars``."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
