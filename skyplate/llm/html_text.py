"""HTML extraction by composite text density.

A page is read into nodes without scripts, styles and the parts that their element or their class or id marks as
boilerplate. Every node has its characters per tag, weighed down by its share of link characters and tags. The sum of
its children's densities singles out the node that holds the main text; the smallest density on the path from it up to
the body is the threshold above which other nodes count as content too. The result is the selected subtrees' text: one
line per block, in page order.

Contract on edge cases: null, empty and text-free pages give the empty text; unclosed and wrongly nested elements are
closed as browsers would; repeated rows are read one by one; an empty table gives an empty result; other columns are
ignored, whatever their names. A very long page is read whole, in time and memory in proportion to its length, however
its tags and quotes are nested; where a quote has no end, quotes no longer count from there on. Ties: of subtrees with
the same sum the first on the page is the main one, and all that reach the threshold are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select noframes xmp annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that hold no article text, and words of a class, id or role that mark such parts.
DROPPED = frozenset("nav footer aside form button head object audio video canvas map datalist dialog menu".split()) | RAW
MARKED = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menubar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies share sharing social related recommended recommendations widget pagination pager skip toolbar masthead complementary contentinfo search".split())
#: Words that may stand beside a marked one in the name of such a part, as in "site-footer"; beside any other word it only
#: tells of the text, as in "related-work" or "search-results".
PARTS = frozenset("a all area article articles aside b bar block blog body bottom box button buttons card cards center col column container content count desktop div entry extra feed fixed float footer form global group head header heading home html icon icons id image img inner item items js layer left level line link links list lists main message meta middle mini mobile module my new news off on outer page pane panel part post posts primary print region right row secondary section sections single site small sticky stories story tab tabs tag text the thread title to top ui unit ul user users view web wide wrap wrapper zone".split()) | MARKED
#: Of these, elements and words that mark a part beside the text, however long; others can also mark what wraps all of it.
ASIDE_TAGS = frozenset("nav footer aside header".split())
ASIDES = frozenset("comment comments disqus respond reply replies related recommended recommendations cookie cookies consent gdpr notice notices alert popup modal overlay newsletter".split())
WRAPPER, ASIDE, CUT = 1, 2, 3
#: A heading of readers' comments.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|readers'|all)\s+)?(?:comments?|responses?|replies|leave a (?:comment|reply))(?:\s*\(?\d+\)?)?:?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one text.
UNITS = frozenset(("article", "main"))
#: Elements that an opening tag of the key closes, up to the nearest of the fences.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
CLOSES_P = BLOCK - {"option", "caption", "tbody", "thead", "tfoot", "tr", "body", "html", "legend", "summary"}
SCOPE = frozenset("table td th button caption html body object article section div li".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup time tt u var".split())


class Node:
    __slots__ = ("tag", "parts", "parent", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "in_link")

    def __init__(self, tag: str, parent: Node | None, drop: int):
        self.tag, self.parent, self.drop, self.parts = tag, parent, drop, []
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def dropped(tag: str, attrs: str, inside_article: bool, by_name: bool = True) -> int:
    """0, or what speaks against an element: WRAPPER and ASIDE are cut unless they enclose the text, CUT always."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return ASIDE if tag in ASIDE_TAGS else WRAPPER if tag in ("form", "dialog", "menu") and not (by_name and HIDDEN.search(attrs)) else CUT
    if attrs and by_name:
        if HIDDEN.search(attrs) and tag not in ("html", "body"):
            return CUT
        if tag not in ("html", "body", "article", "main"):
            found = 0
            for m in NAMED.finditer(attrs):
                for name in (m[1] or m[2] or m[3] or "").lower().split():
                    words = WORDS.findall(name)
                    if not MARKED.isdisjoint(words) and all(w in PARTS or len(w) == 1 for w in words):
                        found = max(found, WRAPPER if ASIDES.isdisjoint(words) else ASIDE)
            return found
        if tag == "article" and not {"comment", "comments", "ad", "ads", "advert", "related", "promo"}.isdisjoint(w for m in NAMED.finditer(attrs) for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower())):
            return CUT
    return 0


LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, ""), (name, "", attributes) of a start tag and ("/", name, "") of an end tag, in one pass over the page."""
    low = page.translate(LOWER)  # as long as the page
    never: set[str] = set()  # what does not occur from some place on: it need not be searched again
    at, text, size = 0, 0, len(page)

    def find(what: str, start: int) -> int:
        where = -1 if what in never else low.find(what, start)
        if where < 0:
            never.add(what)
        return where

    quotes = True
    while at < size:
        start = find("<", at)
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            stop = size if end < 0 else end + 3
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = find(">", start)
            stop = size if end < 0 else end + 1
        else:
            m = TAG.match(page, start)
            end = find(">", m.end()) if m else -1
            if m is None or end < 0:
                at = start + 1
                continue
            if quotes:  # the first > outside quotes
                where = m.end()
                while (q := STOP.search(page, where)) and q[0] != ">":
                    where = find(q[0], q.end()) + 1
                    if not where:
                        break
                if where and q:
                    end = q.start()
                else:
                    quotes = False
            stop = end + 1
        if start > text:
            yield "", page[text:start], ""
        at = text = stop
        if low.startswith(("<!", "<?"), start):
            continue
        tag = m[1].translate(LOWER)
        if low[start + 1] == "/":
            yield "/", tag, ""
            continue
        if tag in RAW:  # its content is text up to its own end tag
            close = find(f"</{tag}", at)
            if close < 0:
                at = size if tag in ("script", "style", "textarea", "title") else at
            else:
                stop = find(">", close)
                at = size if stop < 0 else stop + 1
            text = at
            continue
        yield tag, "", page[m.end() : end]
    if size > text:
        yield "", page[text:], ""


def parse(page: str, by_name: bool = True) -> Node:
    """The tree of a page; parts of a node are its texts and child nodes in page order. Parts that can be boilerplate are marked as such. by_name: class, id and role count too."""
    root = node = Node("html", None, 0)
    open_tags: list[str] = ["html"]
    places: dict[str, list[int]] = {}  # where each tag is open, and, under "block" and "scope", where one of these kinds is
    depth_of = [1]  # how many elements were open when each node on the path was opened, itself included
    skip = articles = 0

    def last(*names: str) -> int:
        """The place of the innermost open element of these, or 0."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def kinds(tag: str) -> list[str]:
        return [tag, *(["#block"] if tag in BLOCK else []), *(["#scope"] if tag in SCOPE else [])]

    def close(n: int) -> None:
        """Close elements until n are open."""
        nonlocal node, articles, skip
        while len(open_tags) > n:
            tag = open_tags.pop()
            for kind in kinds(tag):
                places[kind].pop()
            articles -= tag in UNITS
            if skip and len(open_tags) < skip:
                skip = 0
            if not skip and len(open_tags) < depth_of[-1] and len(depth_of) > 1:
                node = node.parent
                depth_of.pop()

    for tag, text, attrs in tokens(page):
        if not tag:
            if not skip:
                node.parts.append(text)
            continue
        if tag == "/":
            where = last(text)
            if where and text not in ("html", "body"):
                if text not in FORMATTING or last("#block") <= where:
                    close(where)
            elif text == "p" and not skip:
                node.parts.append(Node("p", node, 0))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and (where := last("p")) and last("#scope") <= where:
            close(where)
        if tag in CLOSES and (where := last(*CLOSES[tag])) and last(*FENCES[tag]) < where:
            close(where)
        if tag in VOID:
            if not skip:
                node.parts.append(Node(tag, node, 0))
            continue
        if tag not in SCOPE and attrs.endswith("/"):
            continue
        for kind in kinds(tag):
            places.setdefault(kind, []).append(len(open_tags))
        open_tags.append(tag)
        articles += tag in UNITS
        if skip:
            continue
        drop = dropped(tag, attrs, articles > 0, by_name)
        if drop == CUT:
            node.parts.append("\n" if tag in BLOCK else " ")
            skip = len(open_tags)
            continue
        child = Node(tag, node, drop)
        node.parts.append(child)
        node = child
        depth_of.append(len(open_tags))
    return root


def heads_comments(n: Node) -> bool:
    """Does a plain part start with a heading of readers' comments?"""
    if n.drop or n.tag not in ("div", "section", "ul", "ol"):
        return False
    first = next((p for p in n.parts if isinstance(p, Node) or p.strip()), None)
    return isinstance(first, Node) and first.tag in HEADINGS and len(first.parts) < 9 and COMMENTS.fullmatch(" ".join(html.unescape("".join(p for p in first.parts if isinstance(p, str))).split())) is not None


def prune(root: Node, by_name: bool = True) -> Node:
    """Cut the marked parts, apart from those that enclose the page's largest article or main, or most of its text."""
    order, stack = [], [(root, False, False)]
    within: dict[int, tuple[bool, bool]] = {}  # lies in a part beside the text; in an article or main
    while stack:
        n, aside, inside = stack.pop()
        order.append(n)
        if by_name and heads_comments(n):
            n.drop = ASIDE
        within[id(n)] = aside, inside
        aside, inside = aside or n.drop == ASIDE, inside or n.tag in UNITS
        stack.extend((p, aside, inside) for p in reversed(n.parts) if isinstance(p, Node))
    if not any(n.drop for n in order):
        return root
    k = len(order)
    text, most, end = {}, {}, {}  # characters outside links; those of the largest article or main below; end in order
    after, before = [0] * (k + 1), [0] * (k + 1)  # largest article or main that starts, ends, by a place in order
    for i in range(k - 1, -1, -1):
        n = order[i]
        below = [p for p in n.parts if isinstance(p, Node)]
        end[id(n)] = max([i + 1, *(end[id(p)] for p in below)])
        most[id(n)] = max([0, *(max(most[id(p)], text[id(p)] if p.tag in UNITS else 0) for p in below)])
        own = 0 if n.in_link else sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        text[id(n)] = own + sum(text[id(p)] for p in below)
        if n.drop == ASIDE and not most[id(n)]:
            text[id(n)] = 0
        unit_chars = text[id(n)] if n.tag in UNITS and not within[id(n)][0] else 0
        after[i] = max(after[i + 1], unit_chars)
        before[end[id(n)]] = max(before[end[id(n)]], unit_chars)
    for i in range(k):
        before[i + 1] = max(before[i + 1], before[i])
    total = text[id(root)]
    kept, cut, units = set(), [], False
    stack = [root]
    at = {id(n): i for i, n in enumerate(order)}
    while stack:
        n = stack.pop()
        if n.drop:
            apart = max(before[at[id(n)]], after[end[id(n)]])  # largest article or main that n neither holds nor lies in
            largest = most[id(n)] > 0 and most[id(n)] >= apart
            # beside an article, a promotion can be the longer text; a form cannot
            half = text[id(n)] * 2 > total and (not apart or n.tag in ("form", "dialog", "menu"))
            if not (largest and half and not within[id(n)][1] if n.drop == ASIDE else largest or half):
                cut.append(n)
                continue
            kept.add(id(n))
        units = units or (n.tag in UNITS and text[id(n)] > 0)
        stack.extend(p for p in n.parts if isinstance(p, Node))
    wrappers = [n for n in cut if n.drop == WRAPPER]
    if not units and sum(text[id(n)] for n in wrappers) * 2 > total:
        kept.update(id(n) for n in wrappers)
    for n in order:
        n.parts = [("\n" if p.tag in BLOCK else " ") if isinstance(p, Node) and p.drop and id(p) not in kept else p for p in n.parts]
    return root


def measure(root: Node) -> list[Node]:
    """All nodes in page order, with the counts of their subtrees."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    for n in reversed(order):
        own = sum(len("".join(html.unescape(p).split())) for p in n.parts if isinstance(p, str))
        n.chars += own
        n.link_chars += own if n.in_link else 0
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.tags += n.tags + (n.tag not in VOID)
            n.parent.link_tags += n.link_tags + (n.tag == "a")
    body_ratio = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        c, t, lc, lt = n.chars, n.tags or 1, n.link_chars, n.link_tags
        if c:
            base = math.log(c / ((c - lc) or 1) * lc + body_ratio * c + math.e)
            n.density = c / t * math.log(max(c / (lc or 1) * (t / (lt or 1)), 1.0)) / max(base, 1.0)
    for n in order:
        if n.parent is not None and n.tag not in VOID:
            n.parent.total += n.density
    return order


def select(order: list[Node]) -> list[Node]:
    """Roots of the subtrees that hold the main text, in page order."""
    best = max(order, key=lambda n: n.total)
    if best.total <= 0 and not best.chars:
        return []
    threshold, n = best.density, best
    while n is not None:
        threshold = min(threshold, n.density)
        n = n.parent
    top = {id(n): n for n in order}  # of each subtree the node with the largest sum
    around: dict[int, int] = {}  # characters in outermost articles below each node that encloses some
    unit: dict[int, Node | None] = {}  # the outermost article or main that each node lies in, itself included
    for n in order:
        unit[id(n)] = (unit[id(n.parent)] if n.parent is not None else None) or (n if n.tag in UNITS else None)
    for n in reversed(order):
        if n.parent is not None:
            inner = n.chars if unit[id(n)] is n else around.get(id(n), 0) if unit[id(n)] is None else 0
            if inner:
                around[id(n.parent)] = around.get(id(n.parent), 0) + inner
            if top[id(n)].total >= top[id(n.parent)].total and (top[id(n.parent)] is not n.parent or top[id(n)].total > n.parent.total):
                top[id(n.parent)] = top[id(n)]
    # the densest subtree, and what stands above the threshold beside it
    chosen: set[int] = set()
    stack = [order[0]]
    while stack:
        n = stack.pop()
        if n.density >= threshold and n.chars:
            chosen.add(id(top[id(n)]))
        if id(n) not in chosen:
            stack.extend(p for p in n.parts if isinstance(p, Node))
    units = [n for n in order if unit[id(n)] is n and n.chars]
    # what lies in an article or main is lifted to it; of what consists of such elements for the most part, they are
    # taken with the dense parts beside them
    picked = {id(u) for n in order if id(n) in chosen and (u := unit[id(n)]) is not None}
    for n in order:
        if id(n) in chosen and around.get(id(n), 0) * 2 > n.chars:
            chosen.discard(id(n))
            stack = [n]
            while stack:
                x = stack.pop()
                if id(x) in around:
                    stack.extend(p for p in x.parts if isinstance(p, Node))
                elif x.tag in UNITS or (x.density >= threshold and x.chars):
                    (picked if x.tag in UNITS else chosen).add(id(x))
    # parts of one text are siblings; one below the average of all is no less a part, unless it is a list of links
    parents = {id(u.parent) for u in units if id(u) in picked}
    picked |= {id(u) for u in units if id(u.parent) in parents and u.link_chars * 2 < u.chars}
    headings = set() if picked else {id(n) for n in order if n.tag == "h1"}
    out, stack = [], [order[0]]
    while stack:
        n = stack.pop()
        if id(n) in chosen or id(n) in picked or id(n) in headings:
            out.append(n)
        else:
            stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    return out


def blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    for root in roots:
        text: list[str] = []
        stack: list[Node | str | None] = [root]  # None ends a block
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                text.append(x)
                continue
            if x is not None:
                mark = x.tag in BLOCK
                if x.tag in ("br", "td", "th"):
                    text.append(" ")
                if mark:
                    stack.append(None)
                stack.extend(reversed(x.parts))
                if not mark:
                    continue
            if line := " ".join(html.unescape("".join(text)).split()):
                out.append(line)
            text = []
        if line := " ".join(html.unescape("".join(text)).split()):
            out.append(line)
    return out


def extract(page: str) -> str:
    text = "\n".join(blocks(select(measure(prune(parse(page))))))
    # a page all of whose text stands under a marked name is read by its elements alone
    return text or "\n".join(blocks(select(measure(prune(parse(page, by_name=False), by_name=False)))))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.string()), pa.array([len(t) for t in out], type=pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars bigint")
