"""Main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with its root-to-leaf tag path (tag
names with their classes).  Per path, the length of text outside links and its
punctuation are summed up and divided by the number of the path's blocks:
paragraphs of running text share a path with long, punctuated blocks, menus share
one with many short ones.  The two ratios are fused into one score, whose logarithm is
smoothed over neighbouring blocks in page order.  A path's score is the mean of its
blocks; paths above a threshold relative to the page are content, and their blocks
are the text.  What a page says itself comes first: blocks below elements for
navigation, headers, footers, asides, forms, adverts, notices or comments, by tag,
role or whole class name, take no part, and if content lies in articles, what lies
outside them is left out.  Between content blocks of one article (or of the
smallest element that holds nearly all content) other blocks are let in again unless
they are links alone, and so are headings right before the first one: a short
quotation, a list or a title are not lost.

Null, empty and text-free html gives the empty string.  Repeated rows are
extracted once each.  Null keys and addresses pass through.  An empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: what HTML elements and common names mean --------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
SILENT = RAW | frozenset("head select option button canvas audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
# An open element on the left ends when one on the right begins (p: any block).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
        "head": {"body"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead topbar toolbar footer sidebar aside side widget widgets rail cookie "
    "cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search pagination pager skip hidden copyright legal "
    "disclaimer form".split())
# Words that leave a compound name what it is: site-header, left_sidebar.
NEUTRAL_NAMES = frozenset(
    "site page main top bottom left right bar wrap wrapper container box block area section list links link button "
    "buttons primary secondary global inner outer item items group policy text unit slot".split())
# Reader comments, also as a part of a name, and also where an article holds each of them.
COMMENT_NAMES = frozenset("comment comments comentarios disqus respond replies".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_NAMES = frozenset(
    "article main content story post entry article-body article-content main-content page-content post-content "
    "post-body entry-content story-body".split())

PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡«»]")
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*'|)|[\"'])*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Least score of a content path, as a share of the page's mean score by length.
THRESHOLD = 0.6
# Share of the content that its smallest common element holds at least.
HELD = 0.9


def _furniture_name(name: str) -> bool:
    parts = {p.lower() for p in _PARTS.findall(name)} - {""}
    parts = {p for p in parts if not p.isdigit()}
    return bool(parts & FURNITURE_NAMES) and parts <= FURNITURE_NAMES | NEUTRAL_NAMES


def _comment_name(name: str) -> bool:
    return any(p.lower() in COMMENT_NAMES for p in _PARTS.findall(name))


class Element:
    """An open element: its tag path and what it is for."""

    __slots__ = ("tag", "path", "layout", "furniture", "silent", "linked", "article", "number")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, number: int):
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
        label = tag + "".join("." + c for c in sorted(attributes.get("class", "").split()))
        self.tag, self.number = tag, number
        self.path = f"{parent.path}/{label}" if parent else label
        role = attributes.get("role", "").lower()
        self.article = parent.article if parent else None
        in_article = self.article is not None
        if tag in ARTICLE_TAGS or role in ("main", "article") or (
                tag in BLOCKS and tag not in HEADINGS and tag != "p" and any(n.lower() in ARTICLE_NAMES for n in names)):
            # An article inside the main part narrows it; a block inside an article does not.
            if not in_article or (tag == "article" and self.article[1] != "article"):
                self.article = (number, tag)
        # Said by the page's own structure: goes for all below.
        own = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in attributes or (
            "display:none" in attributes.get("style", "").replace(" ", "")) or (
            tag not in ("html", "body") and any(map(_comment_name, names)))
        self.furniture = own or bool(parent and parent.furniture)
        # Said by a name or a header's place: an article below is none the less an article.
        named = (tag == "header" and not in_article) or (
            tag not in ("html", "body") and any(map(_furniture_name, names)))
        self.layout = tag not in ARTICLE_TAGS and (named or bool(parent and parent.layout))
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.linked = tag == "a" or bool(parent and parent.linked)


class Block:
    __slots__ = ("text", "free", "tag", "path", "article", "chain")

    def __init__(self, text: str, free: int, element: Element, chain: tuple[int, ...]):
        # ``free``: characters outside links, white space apart.
        self.text, self.free, self.tag, self.path = text, free, element.tag, element.path
        self.article, self.chain = element.article, chain


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), markup.unescape(next((v for v in values if v), "")))
    return found


def page_blocks(page: str) -> list[Block]:
    """Text blocks in page order, without those of furniture and silent elements."""
    stack: list[Element] = []
    blocks: list[Block] = []
    parts: list[str] = []
    owner: list = [None, ()]
    made = free = 0

    def end_block() -> None:
        nonlocal free
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, free, *owner))
        parts.clear()
        owner[0], free = None, 0

    def add(raw: str) -> None:
        nonlocal free
        top = stack[-1] if stack else None
        if top is not None and (top.silent or top.furniture or top.layout):
            return
        if raw.strip():
            holder = next((e for e in reversed(stack) if e.tag in BLOCKS), None)
            if owner[0] is None:
                owner[:] = [holder or Element("html", {}, None, -1), tuple(e.number for e in stack)]
            parts.append(markup.unescape(raw))
            if top is None or not top.linked:
                free += sum(map(len, parts[-1].split()))
        elif parts:
            parts.append(raw)

    def close(to: int) -> None:
        if any(e.tag in BLOCKS for e in stack[to:]):
            end_block()
        del stack[to:]

    def close_implied(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            open_tag = stack[i].tag
            if open_tag == "p" and tag in BLOCKS or tag in ENDS.get(open_tag, ()):
                close(i)
                return
            if open_tag in ("ul", "ol", "dl", "table", "div", "section", "article", "body", "td", "th", "blockquote"):
                return

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at:found.start()])
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag:
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag == "br":
            add_space = bool(parts)
            if add_space:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            close_implied(tag)
            end_block()
        if tag in VOID:
            continue
        made += 1
        if found[3].rstrip().endswith("/") and tag in ("path", "circle", "rect", "use", "g"):
            continue
        stack.append(Element(tag, _attributes(found[3]), stack[-1] if stack else None, made))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stack.pop()
            if end is None:
                break
            at = page.find(">", end.end())
            at = size if at < 0 else at + 1
    end_block()
    return blocks


def path_scores(blocks: list[Block]) -> dict[str, float]:
    """Text length and punctuation of every tag path, each by its number of blocks, fused.

    Blocks that are links alone count with no length and no marks.
    """
    count, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        count[b.path] += 1
        if b.free:
            length[b.path] += len(b.text)
            marks[b.path] += len(PUNCTUATION.findall(b.text))
    return {p: length[p] / n * (1 + marks[p] / n) for p, n in count.items()}


def content_paths(blocks: list[Block], threshold: float = THRESHOLD) -> set[str]:
    """The paths whose smoothed score reaches the threshold."""
    scores = path_scores(blocks)
    own = [math.log1p(scores[b.path]) for b in blocks]
    # Weights 1-2-1; the ends count their own score twice more.
    smooth = [(own[max(i - 1, 0)] + 2 * s + own[min(i + 1, len(own) - 1)]) / 4 for i, s in enumerate(own)]
    weight = sum(len(b.text) for b in blocks)
    limit = threshold * sum(s * len(b.text) for s, b in zip(smooth, blocks)) / weight
    total, count = defaultdict(float), defaultdict(int)
    for s, b in zip(smooth, blocks):
        total[b.path] += s
        count[b.path] += 1
    return {p for p, n in count.items() if total[p] / n >= limit}


def content_blocks(blocks: list[Block], threshold: float = THRESHOLD) -> list[Block]:
    """The blocks of the main text, in order."""
    if not blocks:
        return []
    paths = content_paths(blocks, threshold)
    chosen = [i for i, b in enumerate(blocks) if b.path in paths]
    inside = [i for i in chosen if blocks[i].article is not None]
    groups = defaultdict(list)
    if inside:
        for i in inside:
            groups[blocks[i].article].append(i)
        member = lambda i, group: blocks[i].article == group
    else:
        total = sum(len(blocks[i].text) for i in chosen)
        held = defaultdict(int)
        for i in chosen:
            for e in blocks[i].chain:
                held[e] += len(blocks[i].text)
        # Elements are numbered in page order, so the last one that holds nearly all is the smallest.
        holder = max((e for e, n in held.items() if n >= HELD * total), default=None)
        groups[holder] = [i for i in chosen if holder is None or holder in blocks[i].chain]
        member = lambda i, group: group is None or group in blocks[i].chain
    kept = {i for own in groups.values() for i in own}
    for group, own in groups.items():
        first = own[0]
        # Headings right before the first block, links alone apart; also those of a main part around the article.
        for i in range(own[0] - 1, -1, -1):
            if blocks[i].tag in HEADINGS:
                kept.add(i)
                first = i
            elif blocks[i].free:
                break
        kept.update(i for i in range(first, own[-1]) if blocks[i].free and member(i, group))
    return [blocks[i] for i in sorted(kept)]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of one page; blocks are set apart by a blank line."""
    return "\n\n".join(b.text for b in content_blocks(page_blocks(page), threshold)) if page else ""


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))

    def run(frames):
        for frame in frames:
            text = [main_text(h, threshold) for h in frame["html"].tolist()]
            yield pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"].array, "text": text,
                                "n_chars": [len(t) for t in text]})

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
