"""Nodes of pages for the operators that read saved pages: small helpers inside tasks, a page at a time."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd

_VOID = frozenset("area base br col embed hr img input link meta source wbr".split())
_BOXES = frozenset(("div", "li", "article", "section"))
# Parts of class names that mark a card, and hints by which other boxes are taken for one (HINTED at most).
CARD_CLASSES = {
    "review": ("Comment--", "review-item", "ReviewItem", "comment-item", "CommentItem", "rate-item", "evaluation-item"),
    "question": ("qaItem--", "question-item", "QuestionItem", "qa-item", "QaItem", "ask-item", "wenda-item"),
}
CARD_HINTS = {"review": "(?i)(review|comment|rate-item|feedback|evaluation|评价|评论)", "question": "(?i)(qa|question|answer|ask|everyone|wenda|问大家|问答)"}
HINTED = 500
# What marks the conditions and the filters of a page's questions, and how a filter's label reads.
CONDITION, CONDITION_COUNT, FILTER = "conditionItem--", "conditionItemCount--", "(?i)(tag|filter|topic)"
FILTER_TAGS, FILTER_LABEL, TAGS = ("button", "li", "span", "div"), r"([\u4e00-\u9fffA-Za-z]{1,10})\s*(\d{1,7})?", 30
# Where pages name their product and shop.
PANEL = "tbpcDetail_SkuPanelBody"
TITLE_CLASSES = ("product-title", "ProductTitle", "item-title", "ItemTitle", "tb-main-title")
SHOP_CLASSES = ("shop-name", "shopName", "ShopName", "seller-name")
PANEL_TITLE, CLASS_TITLE, JSON_TITLE, META_TITLE, PAGE_TITLE, FILE_TITLE, HEADING = range(7)


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "place", "before", "first", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: int, place: int, before: str, first: int):
        self.tag, self.attrs, self.parent, self.place, self.before, self.first, self.last = tag, attrs, parent, place, before, first, first
        self.classes = attrs.get("class", "")


class Page(HTMLParser):
    """All nodes of a page in order.  A node's text is a range of the page's pieces, so that nesting costs nothing."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.opened: Counter[str] = Counter()  # tags of open nodes
        self.seen: dict[int, dict[str, int]] = {}  # of open parents: children by tag
        self.latest: dict[int, str] = {}  # of open parents: classes of the last child
        self.feed(html)
        self.close()
        while self.open:
            self.nodes[self.open.pop()].last = len(self.pieces)

    def updatepos(self, i, j):
        return j  # lines are not counted

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        counts = self.seen.setdefault(parent, {})
        counts[tag] = counts.get(tag, 0) + 1
        node = Node(tag, {k: v or "" for k, v in attrs}, parent, counts[tag], self.latest.get(parent, ""), len(self.pieces))
        self.latest[parent] = node.classes
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)
            self.opened[tag] += 1

    def handle_endtag(self, tag):
        if self.opened[tag]:
            while True:
                i = self.open.pop()
                self.opened[self.nodes[i].tag] -= 1
                self.nodes[i].last = len(self.pieces)
                self.seen.pop(i, None)
                self.latest.pop(i, None)
                if self.nodes[i].tag == tag:
                    return

    def handle_data(self, data):
        if data.strip():
            self.pieces.append(data.strip())

    def text(self, node: Node, between: str = " ") -> str:
        return between.join(self.pieces[node.first : node.last])

    def chain(self, i: int) -> Iterator[int]:
        while (i := self.nodes[i].parent) >= 0:
            yield i

    def above(self, i: int) -> Iterator[Node]:
        return (self.nodes[j] for j in self.chain(i))


def cards_of(page: Page, kind: str, hinted: int | None = HINTED) -> list[int]:
    """The nodes that are cards: by class, and boxes by hint, without those that hold another.  A box in a card by class is a
    part of it, whatever its name hints at; cards of questions by class leave no room for hints.  Of boxes by hint
    the first `hinted` count (a fixed value of this format; None: all)."""
    marks = CARD_CLASSES[kind]
    by_class = [i for i, n in enumerate(page.nodes) if n.classes and any(c in n.classes for c in marks)]
    if kind == "question" and by_class:
        return by_class
    hint = re.compile(CARD_HINTS[kind])
    known = set(by_class)
    within = lambda i: any(j in known for j in page.chain(i))
    by_hint = [i for i, n in enumerate(page.nodes) if n.attrs and n.tag in _BOXES and hint.search(f"{n.classes} {n.attrs.get('id', '')} {n.attrs.get('data-spm', '')}") and not within(i)][:hinted]
    cards = sorted({*by_class, *by_hint})
    holds, known = set(), set(cards)
    for i in cards:
        if page.nodes[i].tag in _BOXES:
            parent = page.nodes[i].parent
            while parent >= 0 and parent not in holds:
                if parent in known:
                    holds.add(parent)
                parent = page.nodes[parent].parent
    return [i for i in cards if i not in holds] or cards


def _conditions(page: Page) -> Iterator[tuple[str, str]]:
    """Names and counts of conditions.  Nodes stand in order of their first piece, so a condition's count is found by bisection."""
    counts = [n for n in page.nodes if CONDITION_COUNT in n.classes]
    firsts = [n.first for n in counts]
    for node in (n for n in page.nodes if CONDITION in n.classes):
        at = bisect_left(firsts, node.first)
        if at < len(counts) and counts[at].last <= node.last:
            own = counts[at]
            yield " ".join(page.pieces[node.first : own.first] + page.pieces[own.last : node.last]), page.text(own)
        else:
            yield page.text(node), ""


def _filters(page: Page) -> Iterator[tuple[str, str]]:
    """Names and counts in the labels of filters."""
    for node in page.nodes:
        if node.attrs and node.tag in FILTER_TAGS and re.search(FILTER, f"{node.classes} {node.attrs.get('id', '')}") and node.last - node.first <= 2:
            if label := re.fullmatch(FILTER_LABEL, page.text(node)):
                yield label[1], label[2] or ""


def tags_of(page: Page, most: int | None = TAGS) -> list[str]:
    """What a page's questions are about: conditions, or filters where it has none, each once; the first `most` (None: all)."""
    for source in (_conditions, _filters):
        if named := dict.fromkeys(":".join(filter(None, pair)) for pair in source(page) if pair[0]):
            return list(named)[:most]
    return []


def page_rows(kind: str, hinted: int | None = HINTED) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Frames (page, html) to the nodes of their cards."""
    columns = ["page", "node", "card", "tag", "class_name", "attrs", "after", "inside_user", "text", "block", "node_id", "src", "width", "height", "tags"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, html in zip(frame["page"], frame["html"], strict=True):
                page = Page(html)
                tags = tags_of(page) if kind == "question" else []
                for card, root in enumerate(cards_of(page, kind, hinted)):
                    inside = {root}
                    for i in range(root, len(page.nodes)):
                        n = page.nodes[i]
                        if i != root and n.parent not in inside:
                            break
                        inside.add(i)
                        a, user = n.attrs, n.tag == "span" and any("userInfo--" in x.classes for x in page.above(i))
                        rows.append((name, i, card, n.tag, n.classes, f"{n.classes} {a.get('id', '')}", n.before, user, page.text(n), page.text(n, "\n") if i == root else None, a.get("data-comment-id") or a.get("data-id") or a.get("id", ""), a.get("src", "") if n.tag == "img" else "", a.get("width", ""), a.get("height", ""), tags if i == root else None))
            yield pd.DataFrame(rows, columns=columns)

    return run


def _products(page: Page, html: str) -> list[dict]:
    """The JSON-LD products of a page."""
    out = []
    for m in re.finditer(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html):
        try:
            data = json.loads(m[1])
        except ValueError:
            continue
        for node in data if isinstance(data, list) else [data]:
            if isinstance(node, dict):
                graph = node.get("@graph")
                out += [x for x in [node, *(graph if isinstance(graph, list) else [])] if isinstance(x, dict) and str(x.get("@type", "")).lower() == "product"]
    return out


def _in_panel(page: Page, i: int) -> bool:
    """A span in the first div in a div in a div in one of the panel's first two divs."""
    chain = [page.nodes[i], *page.above(i)][:6]
    if len(chain) < 6 or chain[0].tag != "span" or any(n.tag != "div" for n in chain[1:5]):
        return False
    return chain[1].place == 1 and chain[4].place in (1, 2) and chain[5].attrs.get("id") == PANEL


def titles_and_shops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames (page, html, file_name, panel) to candidates for title (with their rank) and shop, in order."""
    for frame in frames:
        titles_of, shops_of = [], []
        for html in frame["html"]:
            page, titles = Page(html), []
            products = _products(page, html)
            for i, n in enumerate(page.nodes):
                if n.tag == "span" and _in_panel(page, i):
                    titles += [(PANEL_TITLE, n.attrs.get("title", "")), (PANEL_TITLE, page.text(n))]
            for part in TITLE_CLASSES:
                titles += [(CLASS_TITLE, page.text(n)) for n in page.nodes if part in n.classes]
            titles += [(JSON_TITLE, str(p.get("name", ""))) for p in products]
            for name in ("og:title", "twitter:title"):
                titles += [(META_TITLE, n.attrs.get("content", "")) for n in page.nodes if n.tag == "meta" and name in (n.attrs.get("property"), n.attrs.get("name"))][:1]
            titles += [(PAGE_TITLE, page.text(n)) for n in page.nodes if n.tag == "title"][:1]
            titles += [(HEADING, page.text(n)) for n in page.nodes if n.tag == "h1"]
            for part in ("title", "Title"):
                titles += [(HEADING, page.text(n)) for n in page.nodes if part in n.classes]
            first = products[0] if products else {}
            named = lambda x: str(x.get("name", "")) if isinstance(x, dict) else x if isinstance(x, str) else ""
            shops = [named(first.get("seller")) if isinstance(first.get("seller"), dict) else ""]
            for part in SHOP_CLASSES:
                shops += [page.text(n) for n in page.nodes if part in n.classes][:1]
            shops.append(named(first.get("brand")))
            titles_of.append([{"rank": r, "text": t} for r, t in titles if t])
            shops_of.append([x for x in shops if x])
        yield pd.DataFrame({"page": frame["page"], "file_name": frame["file_name"], "panel": frame["panel"], "titles": titles_of, "shops": shops_of})
