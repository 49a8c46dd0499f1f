"""Main text of web pages by consensus of a host's pages.

Every page is read once to find its main container: the deepest element that holds nearly all of the page's text
outside boilerplate, or the article around it. Its path of tags and classes, with digits generalised, is the page's vote, weighted by the text's
logarithm; votes are added up per host in Spark. Pages are then read again and their text comes from the elements on the host's
winning path, or, where a page has none or its own article holds clearly more, from its own container.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, limit_batches

#: Share of a page's text that its container must hold.
HOLDS = 0.8
BROADCAST_HOSTS = 250_000

_OPEN = re.compile(r"<(?:!--|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
_STOP = re.compile(r"[>\"']")
_RAW = frozenset("script style noscript template textarea svg iframe object select title annotation annotation-xml".split())
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mphantom mfenced menclose mtable mtr mtd semantics".split()
)
_SKIP_TAG = frozenset("nav footer aside form button dialog menu head audio video canvas".split())
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_SKIP_WORD = frozenset(
    "nav navbar navigation menu sidebar footer cookie cookies consent notice banner ad ads advert adverts advertisement advertising promo sponsor sponsored "
    "comment comments disqus respond reply replies share sharing social related breadcrumb breadcrumbs newsletter subscribe subscription popup modal "
    "overlay widget widgets pagination pager login search masthead toolbar gdpr alert skip teaser teasers".split()
)
_HEAD_WORD = frozenset("header topbar".split())
#: Words that say nothing of what an element holds: beside them a listed word speaks for the whole name (comment-list, site-footer).
_NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content div fixed form group inner item items left link links list main mobile outer page panel post posts "
    "primary right row secondary section site slot sticky text title top unit user wrap wrapper".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol dl table div article section body".split())
_TEXT_TAG = frozenset("p h1 h2 h3 h4 h5 h6 a".split())
_NO_STEP = frozenset("p html li h1 h2 h3 h4 h5 h6 pre blockquote".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_TAG = re.compile(r"[^.#]*")
#: After one of these, a word of a class name tells of the layout: no-sidebar, content-with-sidebar.
_STATE = frozenset("no not has with without".split())
_KEPT, _DOUBTFUL, _SKIPPED = 0, 1, 2
_AROUND = "around"


def _skipped(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether an element is boilerplate, or doubtful: then its share of links decides. A listed word alone or with neutral ones is enough, one among other words isn't."""
    if tag in _SKIP_TAG or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _SKIP_ROLE:
        return _SKIPPED
    if (style := attrs.get("style")) and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I):
        return _SKIPPED
    if tag == "header" and not in_article:
        return _SKIPPED
    if tag in ("body", "html", "article", "main"):
        return _KEPT
    out = _KEPT
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        found = other = False
        for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()):
            if w in _STATE:
                break
            if w in _SKIP_WORD or (w in _HEAD_WORD and not in_article):
                found = True
            elif w not in _NEUTRAL:
                other = True
        if found:
            out = max(out, _DOUBTFUL if other else _SKIPPED)
    return out


class Page:
    """Blocks of a page outside boilerplate, in order, and the tree of its container paths.

    Node 0 is the empty path; parent and step tell the others, each made after its parent. Elements with the same path are one node.
    """

    def __init__(self) -> None:
        self.parent, self.step = [-1], [""]
        self._children: dict[tuple[int, str], int] = {}
        #: (node, text, whether it is all links)
        self.blocks: list[tuple[int, str, bool]] = []

    def child(self, node: int, step: str) -> int:
        found = self._children.get((node, step))
        if found is None:
            found = self._children[node, step] = len(self.parent)
            self.parent.append(node)
            self.step.append(step)
        return found

    def chain(self, node: int) -> list[int]:
        """From the root's child to the node."""
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def path(self, node: int) -> str:
        return " > ".join(self.step[k] for k in self.chain(node))

    def find(self, path: str) -> int | None:
        node: int | None = 0
        for step in path.split(" > "):
            node = self._children.get((node, step))
            if node is None:
                return None
        return node

    def sums(self, linked: bool = False) -> tuple[list[int], list[int]]:
        """Characters that aren't just links (or that are): of each node with all below it, of each node alone."""
        own = [0] * len(self.parent)
        for node, text, all_links in self.blocks:
            if all_links == linked:
                own[node] += len(text)
        size = own.copy()
        for k in range(len(size) - 1, 0, -1):
            size[self.parent[k]] += size[k]
        return size, own

    def below(self, node: int) -> list[bool]:
        """Whether each node is ``node`` or below it."""
        out = [k == node for k in range(len(self.parent))]
        for k in range(node + 1, len(out)):
            out[k] = out[self.parent[k]]
        return out


def _tag_end(html: str, at: int) -> int:
    """Behind the > of a tag whose name ends at ``at``; a quote that isn't closed doesn't count. There is a > behind ``at``."""
    j = at
    while m := _STOP.search(html, j):
        if m[0] == ">":
            return m.end()
        close = html.find(m[0], m.end())
        if close < 0:
            break
        j = close + 1
    return html.index(">", at) + 1


def parse(html: str) -> Page:
    """Elements without an end tag end with their parent; scripts, styles and comments end with the page if they never end. White space
    inside a block is one space; character references are decoded once. Time is in proportion to the page, however deep it is."""
    page = Page()
    # of each open element: tag, node, skipped, inside an article, links open, number of the innermost doubtful element, place of the innermost list, table or section
    top: tuple = ("", 0, False, False, 0, 0, 0)
    stack: list[tuple] = [top]
    open_: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack
    doubts = [-1]  # the doubtful element around each, of which 0 is none
    doubtful: list[int] = []  # of each block
    parts: list[str] = []
    plain = False

    def flush() -> None:
        nonlocal plain
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                page.blocks.append((top[1], text, not plain))
                doubtful.append(top[5])
            parts.clear()
        plain = False

    def pop(tag: str) -> None:
        """Close the innermost open element of that name and all in it."""
        nonlocal top
        while True:
            closed = stack.pop()[0]
            open_[closed].pop()
            if closed == tag:
                break
        top = stack[-1]

    def push(tag: str, step: str, verdict: int, article: bool, link: int) -> None:
        nonlocal top
        doubt = top[5]
        if verdict == _DOUBTFUL:
            doubts.append(doubt)
            doubt = len(doubts) - 1
        node = page.child(top[1], step) if step else top[1]
        top = (tag, node, top[2] or verdict == _SKIPPED, top[3] or article, top[4] + link, doubt, len(stack) if tag in _HOLDERS else top[6])
        open_[tag].append(len(stack))
        stack.append(top)

    at, last = 0, html.rfind(">")
    while (m := _OPEN.search(html, at)) and m.start() <= last:
        if m.start() > at and not top[2]:
            piece = html[at : m.start()]
            parts.append(piece)
            if not top[4] and not plain and not piece.isspace():
                plain = True
        tag = m["tag"]
        if tag is None:
            end = html.find("-->", m.end()) if m[0] == "<!--" else html.find(">", m.end())
            at = len(html) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        tag, begin = tag.lower(), m.end()
        if begin > last:
            at = m.start()
            break
        at = _tag_end(html, begin)
        attrs_text = html[begin : at - 1]
        if tag in _RAW and not m["end"]:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = closing.end() if closing else len(html)
            continue
        if tag in _VOID:
            if tag == "br":
                if not top[2]:
                    parts.append(" ")
            elif tag not in _INLINE and not top[2]:
                flush()
            continue
        inline = tag in _INLINE
        if m["end"]:
            if not inline:
                flush()
            if open_[tag] and not (inline and stack[-1][0] not in _INLINE):
                pop(tag)
            continue
        if inline:
            # formatting that never ends must not hide what follows, so only links are noted
            if tag == "a":
                if open_["a"]:
                    pop("a")
                push("a", "", _KEPT, False, 1)
            continue
        flush()
        while top[0] in _TEXT_TAG:
            pop(top[0])
        closed = max(((open_[t][-1], t) for t in _CLOSES.get(tag, ()) if open_[t]), default=(0, ""))
        if closed[0] > top[6]:
            pop(closed[1])
        if attrs_text.endswith("/") and tag in ("p", "div", "span"):
            continue
        attrs = {k.lower(): next((v for v in x if v), "") for k, *x in _ATTR.findall(attrs_text)} if attrs_text else {}
        verdict = _skipped(tag, attrs, top[3])
        step = ""
        if tag not in _NO_STEP:
            classes = "".join(f".{c}" for c in sorted(_DIGITS.sub("0", attrs.get("class", "")).split()))
            step = tag + (classes or (f"#{_DIGITS.sub('0', attrs['id'])}" if attrs.get("id") else ""))
        push(tag, step, verdict, tag in ("article", "main"), 0)
    if at < len(html) and not top[2]:
        tail = re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", html[at:])
        parts.append(tail)
        plain = plain or bool(tail.strip())
    flush()
    if len(doubts) > 1:
        _drop_link_lists(page, doubtful, doubts)
    return page


def _drop_link_lists(page: Page, doubtful: list[int], doubts: list[int]) -> None:
    """Drop the blocks of doubtful elements that hold more text in links than outside."""
    weight = [0] * len(doubts)
    for (_, text, linked), d in zip(page.blocks, doubtful, strict=True):
        weight[d] += len(text) if linked else -len(text)
    for d in range(len(doubts) - 1, 0, -1):
        if doubts[d] > 0:
            weight[doubts[d]] += weight[d]
    gone = [d > 0 and weight[d] > 0 for d in range(len(doubts))]
    for d in range(1, len(doubts)):
        gone[d] = gone[d] or gone[max(doubts[d], 0)]
    page.blocks = [x for x, d in zip(page.blocks, doubtful, strict=True) if not gone[d]]


def _marked(step: str) -> str:
    tag = _TAG.match(step)[0]
    return tag if tag in ("article", "main") else ""


def _deepest(page: Page, size: list[int]) -> int:
    """The deepest node that holds nearly all text which isn't just links; nodes that do are one line."""
    if not size[0]:
        return 0
    node, depth, best = 0, [0] * len(size), 0
    for k in range(1, len(size)):
        depth[k] = depth[page.parent[k]] + 1
        if size[k] >= HOLDS * size[0] and depth[k] > best:
            node, best = k, depth[k]
    return node


def _whole(page: Page, node: int, own: list[int]) -> int:
    """The outermost article that a node is in, else its outermost main, else the outermost element below the body that has text of its own beside it."""
    chain = page.chain(node)
    for tag in ("article", "main"):
        for k in chain:
            if _marked(page.step[k]) == tag:
                return k
    for k in chain[:-1]:
        if own[k] and _TAG.match(page.step[k])[0] != "body":
            return k
    return node


def container(html: str) -> tuple[str, int]:
    """Path of the page's main container and its number of characters that aren't just links.

    It's the deepest path that holds nearly all of them, or what encloses that as one text: see _whole.
    """
    page = parse(html)
    size, own = page.sums()
    node = _whole(page, _deepest(page, size), own)
    return page.path(node), size[node]


def text_of(html: str, winner: str | None = None) -> str:
    """The blocks on the winning path, or of the page's own container where there are none; joined by an empty line.

    A page's own container also goes first where it is an article or main of which the winning path holds clearly less,
    or where it encloses the winning path as one text. Outside articles and mains the text goes on beside the container: see _beside.
    """
    page = parse(html)
    size, own = page.sums()
    deep = _deepest(page, size)
    mine = _whole(page, deep, own)
    node = page.find(winner) if winner else mine
    if node is None:
        node = mine
    elif node != mine and size[node] < size[mine]:
        encloses = mine in (0, *page.chain(node))
        marked = bool(_marked(page.step[mine]))
        if (marked and (encloses or size[node] < HOLDS * size[mine])) or (encloses and mine != deep):
            node = mine
    inside = page.below(node)
    if not any(inside[k] for k, _, _ in page.blocks):
        node = mine
        inside = page.below(node)
    if not any(_marked(page.step[k]) for k in page.chain(node)):
        inside = _beside(page, node, inside, size)
    return "\n\n".join(text for k, text, linked in page.blocks if inside[k] and (inside[k] is not _AROUND or not linked))


def _beside(page: Page, node: int, inside: list[bool], size: list[int]) -> list:
    """``inside`` with what stands beside the container: elements beside it or beside one around it that hold more text outside links than in them, and text
    directly in an element around it that isn't just links (_AROUND)."""
    links, _ = page.sums(linked=True)
    around = [False] * len(page.parent)
    for k in (0, *page.chain(node)):
        around[k] = k != node
    out: list = list(inside)
    for k in range(len(out)):
        if around[k]:
            out[k] = _AROUND
        elif not inside[k]:
            above = page.parent[k]
            out[k] = size[k] > links[k] if around[above] else out[above]
    return out


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for host, html in zip(batch.column(0), batch.column(1), strict=True):
            path, n = container(html.as_py() or "")
            if path:
                votes[host.as_py(), path] += log1p(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of(html.as_py() or "", path.as_py()) for html, path in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], ["id", "url", "text", "n_chars", "path"])


def host_of(url: Column) -> Column:
    """Lower-case host name of a URL, without user, port and a leading www or m; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.|m\.)?([^/:?#]+)", 1)
    return host


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the winning container path of each host; ties go to the path of least code points."""
    limit_batches(pages.sparkSession)
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_vote, "host string, path string, votes double")
    # rounded, so that the order of additions doesn't matter
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    best = votes.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), "path")).alias("best"))
    return best.select("host", "best.path", "best.votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points), path (the host's winning path, null if it has none).

    Null html counts as empty and gives an empty text; null or odd urls share one host; ids may repeat; an empty table gives an empty one.
    """
    paths = cut(host_paths(pages, url_col, html_col))
    hosts = paths.select("host", "path")
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = read.join(broadcast_below(hosts, hosts.count(), BROADCAST_HOSTS), "host", "left").select("id", "url", "html", "path")
    kind = read.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long, path string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
