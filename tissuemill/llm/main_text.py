"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "td", "th", "ul", "ol", "dl", "blockquote", "figure", "details", "header"}
_BLOCKS = _CONTAINERS | _HEADINGS | {
    "address", "aside", "caption", "dd", "dialog", "dir", "dt", "fieldset", "figcaption", "footer", "form", "hgroup", "hr", "legend", "li", "menu", "nav", "option", "p", "pre", "summary", "tbody", "tfoot", "thead", "tr"}
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is no markup; textarea and title are shown as forms and tabs, never in the text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_NEVER = _RAW - {"xmp"} | {"aside", "audio", "button", "canvas", "dialog", "fieldset", "footer", "form", "head", "input", "menu", "nav", "noscript", "object", "select", "svg", "template", "video"}
#: What may stand in a head; anything else ends it.
_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: What the start of an element ends if it is open: the elements, and those beyond which is not looked.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words of class names and ids that mark what is no part of an article; the second list does not where the name also says that it belongs to one.
_ASIDE = {
    "ad", "ads", "adsbygoogle", "adsense", "adslot", "banner", "consent", "copyright", "disclaimer", "discussion", "disqus", "gdpr", "login", "masthead", "modal", "notice", "notices", "notification", "outbrain", "overlay", "pager",
    "pagination", "paywall", "recommendations", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "signup", "social", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar"}
_ASIDE_LIKE = re.compile(r"^(advert|breadcrumb|comment(?!ar)|cookie|footer|navbar|newsletter|popup|promo|sidebar|sponsor|(site|page|top)header)|(banner|comments|footer|menu|nav|navigation|sidebar|widget)$")
_UNLESS_OWN = {"header", "meta", "tags", "alert", "author", "byline", "skip"}
_OWN = {"article", "articlebody", "blogpost", "body", "content", "entry", "main", "post", "story", "text"}
#: A class name with such a word tells of a state, not of a part.
_STATE = {"after", "before", "disabled", "enabled", "has", "is", "js", "no", "with", "without"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|href|itemprop|aria-hidden)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = re.compile("[,;،、，]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    """An element; ``parent`` is its place in the list of elements, -1 for none."""

    tag: str
    parent: int
    dropped: bool = False
    own: bool = False
    link: bool = False
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0


@dataclass(slots=True)
class Block:
    """Text between two starts or ends of block elements."""

    node: int
    pieces: list[tuple[int, str]] = field(default_factory=list)
    text: str = ""


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """If an element's names and attributes say that it is beside the article, that it is the article, and that it is a link."""
    aside = own = link = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for word in value.split():
                words = {w.lower() for w in _NAME_WORD.findall(word)}
                belongs = bool(words & _OWN)
                aside |= not words & _STATE and (bool(words & _ASIDE) or any(map(_ASIDE_LIKE.search, words)) or (bool(words & _UNLESS_OWN) and not belongs))
                own |= belongs
        elif name == "role":
            aside, own = aside or value.lower() in _ROLES, own or value.lower() in ("main", "article")
        elif name == "itemprop":
            own |= value.lower() == "articlebody"
        elif name == "style":
            aside |= bool(_HIDDEN.search(value))
        elif name == "href":
            link = tag == "a"
        else:
            aside |= name == "hidden" or value.lower() == "true"
    return aside, own, link


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The elements of a page in order, each after its parent, and its blocks of text.

    Missing ends are added as browsers do for paragraphs, list items, table cells and
    whatever an outer end closes; ends without a start are left out.
    """
    nodes, blocks, stack, open_ = [Node("html", -1)], [Block(0)], [0], {"html": 1}
    at, size = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            blocks[-1].pieces.append((stack[-1], piece))

    def cut() -> None:
        if blocks[-1].pieces:
            blocks.append(Block(0))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            open_[tag] -= 1
            if tag in _BLOCKS:
                cut()

    def close(tags: set[str], stop: set[str]) -> None:
        if any(open_.get(t) for t in tags):
            for depth in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[depth]].tag
                if tag in tags:
                    close_to(depth)
                    if tags != {"tr", "td", "th"} or tag == "tr":
                        return
                elif tag in stop:
                    return

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            same = _HEADINGS if tag in _HEADINGS else {tag}
            if tag == "br":
                text(" ")
            elif any(open_.get(t) for t in same):
                # the end of an inline element does not end a block inside it
                close(same, set() if tag in _BLOCKS else _BLOCKS)
            continue
        if tag == "br":
            text(" ")
        if tag in ("html", "body") and open_.get(tag) and tag != "html":
            continue
        if tag not in _HEAD:
            close({"head"}, set())
        if tag in _BLOCKS:
            close({"p"}, {"td", "th", "table", "caption", "button", "object"})
            cut()
        if tag in _ENDS:
            close(*_ENDS[tag])
        aside, own, link = _marks(tag, m[3] or m[6] or "") if (m[3] or m[6]) else (False, False, False)
        parent = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], tag in _NEVER or (aside and tag not in ("html", "body", "article", "main")), own or tag in ("article", "main"), link or parent.link))
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            end_at = end.start() if end else size
            if tag == "xmp":
                stack.append(len(nodes) - 1)
                text(page[at:end_at].replace("&", "&amp;"))
                stack.pop()
            at = end_at
        elif tag not in _EMPTY:
            stack.append(len(nodes) - 1)
            open_[tag] = open_.get(tag, 0) + 1
    return nodes, blocks


def extract(page: str | None) -> str:
    """The article of a page: its blocks in order, one a line; empty if there is none.

    Elements that are never part of an article (menus, forms, scripts, what is hidden or
    named as advert, notice, comments …) are left out, unless an article lies inside them.
    Each other block passes a point, one for each comma and one for each hundred
    code points to the container it stands in, half of that to the next one outwards and so on; headings pass
    little. What is in links counts nothing, and a container loses the share of its text that links hold. The container with
    the most points is the article, wholly if an ``article`` or ``main`` is around it; of
    its siblings those stay that have a fifth of its points, or are prose of few links, or head it.
    """
    if not page:
        return ""
    nodes, blocks = parse(page)
    holds = [n.tag in ("article", "main") and not n.dropped for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        up = nodes[n.parent]
        inside[i] = inside[n.parent] or n.tag in ("article", "main")
        n.dropped = up.dropped or (n.dropped and not holds[i]) or (n.tag == "header" and not inside[i] and not holds[i])
    kept: list[Block] = []
    for b in blocks:
        pieces = [(i, html.unescape(t)) for i, t in _joined(b.pieces) if not nodes[i].dropped]
        b.text = " ".join("".join(t for _, t in pieces).split())
        if not b.text:
            continue
        i = pieces[0][0]
        while nodes[i].tag not in _BLOCKS:
            i = nodes[i].parent
        b.node = i
        kept.append(b)
        in_links = min(len(b.text), sum(len(t.strip()) for j, t in pieces if nodes[j].link))
        share = 1 - in_links / len(b.text)
        points = share * (0.1 if nodes[i].tag in _HEADINGS else 1 + len(_COMMAS.findall(b.text)) + len(b.text) / 100)
        while i >= 0:
            nodes[i].chars += len(b.text)
            nodes[i].link_chars += in_links
            if nodes[i].tag in _CONTAINERS:
                nodes[i].score += points
                points /= 2
            i = nodes[i].parent
    if not kept:
        return ""
    best, most = 0, -1.0
    for i, n in enumerate(nodes):
        if n.chars and n.tag in _CONTAINERS:
            n.score = (n.score + 25 * n.own) * (1 - n.link_chars / n.chars)
            if n.score > most:
                best, most = i, n.score
    while nodes[best].tag not in ("article", "main") and inside[best]:
        best = nodes[best].parent
    chosen = {best} | (set() if nodes[best].tag in ("article", "main") else _siblings(nodes, kept, best))
    lines = []
    for b in kept:
        i = b.node
        while i >= 0 and i not in chosen and not _is_menu(nodes[i]):
            i = nodes[i].parent
        if i in chosen:
            lines.append(b.text)
    return "\n".join(lines)


def _joined(pieces: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """Neighbouring pieces of one element as one, so that a character reference is never cut."""
    held: tuple[int, str] | None = None
    for i, t in pieces:
        if held and held[0] == i:
            held = (i, held[1] + t)
        else:
            if held:
                yield held
            held = (i, t)
    if held:
        yield held


def _is_menu(n: Node) -> bool:
    """If a list, table or division is of links for the most part."""
    return n.tag in ("ul", "ol", "dl", "table", "div", "section") and 3 * n.link_chars > 2 * n.chars


def _siblings(nodes: list[Node], kept: list[Block], best: int) -> set[int]:
    """Siblings of the best container that belong to it."""
    out, last = set(), {b.node: b.text for b in kept}
    found = [i for i, n in enumerate(nodes) if n.parent == nodes[best].parent and n.chars and i != best and not n.dropped]
    for i in found:
        n = nodes[i]
        if n.tag in _CONTAINERS:
            prose = 5 * n.score >= nodes[best].score
        elif n.tag in _HEADINGS:
            prose = i < best
        else:
            prose = 4 * n.link_chars < n.chars and (n.chars > 80 or last.get(i, "").endswith((".", "!", "?", "…", "。")))
        if prose:
            out.add(i)
    return out


def main_texts(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, text)`` of every row of ``pages``: what :func:`extract` finds in its whole HTML, beside columns to be kept.

    White space inside a block (as Unicode has it) becomes one space. Rows stay apart, repeated ids too; a page
    that is null, empty or without text gives an empty text; an empty table gives no row. A page is one task's work and
    takes some ten times its length there; none is cut.
    """
    keep = keep or []
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"))
    schema = rows.drop("html").withColumn("text", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return rows.mapInArrow(run, schema).toDF("id", *keep, "text")
