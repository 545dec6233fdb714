"""HTML without a browser: nodes, texts, links and style rules, through the standard parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import collapse_lines, cut_after, web_whitelist

#: Elements without an end, elements whose content is no text, and elements that are taken away around their content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style form iframe frame frameset object embed noscript applet link meta head title input button select textarea option".split())
UNWRAPPED = frozenset("span font ul li ol div a label p header ins time article aside html body".split())
SAFE_ATTRIBUTES = frozenset("src color href title class name id".split())
KNOWN = UNWRAPPED | VOID | frozenset(
    "abbr address b bdo big blockquote caption center cite code colgroup dd del dfn dl dt em fieldset figure figcaption footer h1 h2 h3 h4 h5 h6 i kbd legend main map mark menu nav pre q s samp"
    " section small strike strong sub sup table tbody td tfoot th thead tr tt u var".split()
)
END_OF_POST = "Latest Posts"
#: Elements nested deeper than this stand beside each other.
MOST_DEPTH = 300
_CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "article", "section"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    @property
    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in the order of the document."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, dropped: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in dropped:
                stack += reversed(node.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        while tag in _CLOSED_BY.get(self.at.tag, ()):
            self.at, self.depth = self.at.parent, self.depth - 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < MOST_DEPTH:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node, up = self.at, 0
        while node.parent is not None and node.tag != tag:
            node, up = node.parent, up + 1
        if node.parent is not None:
            self.at, self.depth = node.parent, self.depth - up - 1

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; what is wrong in it is closed or passed over."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def sanitized(node: Node) -> str:
    """Markup of a tree without scripts, styles, forms, frames, comments and unknown elements; harmless attributes stay."""
    from html import escape

    def inner(n: Node) -> str:
        return "".join(escape(c, quote=False) if isinstance(c, str) else outer(c) for c in n.children)

    def outer(n: Node) -> str:
        if n.tag in DROPPED:
            return ""
        if n.tag in UNWRAPPED or n.tag not in KNOWN:
            return inner(n)
        kept = "".join(f' {k}="{escape(v)}"' for k, v in n.attributes.items() if k in SAFE_ATTRIBUTES and not v.lower().lstrip().startswith("javascript:"))
        return f"<{n.tag}{kept}>" + ("" if n.tag in VOID else f"{inner(n)}</{n.tag}>")

    return inner(node)


def _map(pages: DataFrame, key: str, html: str, rows: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    source = pages.select(F.col(key), F.col(html).cast("string").alias("html"))
    kinds = f"`{key}` {source.schema[0].dataType.simpleString()}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                keys: list = []
                found: list[tuple] = []
                for k, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = rows(h)
                    found += own
                    keys += [k] * len(own)
                columns = [pa.array(keys, b.schema.field(0).type)] + [pa.array([r[n] for r in found], t) for n, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(kinds))
    names, types = arrow.names, arrow.types[1:]
    return source.mapInArrow(run, kinds)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, node_id, parent_id, tag, classes, text)``: the elements of each page in order; text is the element's own."""

    def rows(h: str | None) -> list[tuple]:
        number: dict[int, int] = {}
        out = []
        for n, node in enumerate(x for x in parse(h).walk() if x.tag):
            number[id(node)] = n
            out.append((n, number.get(id(node.parent)), node.tag, node.classes, "".join(c for c in node.children if isinstance(c, str))))
        return out

    return _map(pages, key, html, rows, "node_id int, parent_id int, tag string, classes array<string>, text string")


def content(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, seq, tag, text, is_cut)``: the non-blank strings of each page in order with the element they stand in; a paragraph is a cut."""

    def rows(h: str | None) -> list[tuple]:
        out: list[tuple] = []

        def walk(node: Node) -> None:
            for c in node.children:
                if isinstance(c, str):
                    if c.strip() and node.tag not in ("script", "style"):
                        out.append((len(out), node.tag, c, node.tag == "p"))
                else:
                    walk(c)

        walk(parse(h))
        return out

    return _map(pages, key, html, rows, "seq int, tag string, text string, is_cut boolean")


def visible_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, text)``: a page's title and what it shows."""
    return _map(pages, key, html, lambda h: [(parse(h).text(frozenset(("script", "style", "noscript"))),)], "text string")


def post_text(pages: DataFrame, key: str = "page_id", html: str = "html", tag: str = "div", css_class: str | None = "post", end: str = END_OF_POST) -> DataFrame:
    """``(key, text)``: the text of a page's first post, sanitised, up to the end mark and cleaned; without the mark as it is; null without a post."""

    def rows(h: str | None) -> list[tuple]:
        post = next((n for n in parse(h).walk() if n.tag == tag and (css_class is None or css_class in n.classes)), None)
        return [(None if post is None else parse(sanitized(post)).text(),)]

    found = _map(pages, key, html, rows, "text string")
    cleaned = web_whitelist(collapse_lines(cut_after(F.col("text"), end)))
    return found.select(key, F.when(F.instr("text", end) > 0, cleaned).otherwise(F.col("text")).alias("text"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", rel: str | None = "bookmark", most: int | None = None) -> DataFrame:
    """``(key, seq, href)``: a page's links in order, those of a relation if given, the first ``most`` if given."""

    def rows(h: str | None) -> list[tuple]:
        found = [n.attributes["href"] for n in parse(h).walk() if n.tag == "a" and "href" in n.attributes and (rel is None or rel in n.attributes.get("rel", "").split())]
        return list(enumerate(found[:most]))

    return _map(pages, key, html, rows, "seq int, href string")


_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_IDENT = re.compile(r"[.#]?(-?[A-Za-z_][\w-]*)")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)


def style_rules(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """``(key, ident, prop, val)`` of the longest style block: the first name of each selector; of repeated rules the last one; only numbers."""

    def rows(h: str | None) -> list[tuple]:
        blocks = [n.text() for n in parse(h).walk() if n.tag == "style" and n.attributes.get("type", "text/css") == "text/css"]
        found: dict[str, str] = {}
        for selector, body in _RULE.findall(_COMMENT.sub("", max(blocks, key=len, default=""))):
            if not selector.strip().startswith("@") and (m := _IDENT.search(selector)):
                found[m.group(1)] = body
        out = []
        for ident, body in found.items():
            for declaration in body.split(";"):
                prop, _, value = declaration.partition(":")
                if m := re.match(r"\s*(-?\d+(?:\.\d+)?)", value):
                    out.append((ident, prop.strip(), float(m.group(1))))
        return out

    return _map(pages, key, html, rows, "ident string, prop string, val double")


def boxes(pages: DataFrame, key: str = "doc_id", html: str = "html", class_part: str = "x") -> DataFrame:
    """``(key, box_index, page_number, text, len, tag_attributes)`` of a rendered document: the divisions whose class holds ``class_part``, by the pages marked ``data-page-no``."""

    def rows(h: str | None) -> list[tuple]:
        out: list[tuple] = []
        for number, page in enumerate(n for n in parse(h).walk() if n.tag == "div" and "data-page-no" in n.attributes):
            for n in page.walk():
                if n.tag == "div" and n is not page and class_part in n.attributes.get("class", ""):
                    text = n.text()
                    out.append((len(out), number, text, len(text), n.classes))
        return out

    return _map(pages, key, html, rows, "box_index int, page_number int, text string, len int, tag_attributes array<string>")
