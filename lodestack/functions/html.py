"""HTML as text and as API symbols, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Elements without an end tag, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset(("script", "style"))
#: An open element of the key is ended by the start of one of these.
ENDED_BY = {"p": frozenset("p div ul ol dl table pre h1 h2 h3 h4 h5 h6 section article".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.items = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def children(self, tag: str) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and x.tag == tag]

    def all(self):
        """This node and those below, in document order; deep trees need no recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))

    def strings(self, without: str = ""):
        stack = list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x.tag != without and x.tag not in MUTE:
                stack.extend(reversed(x.items))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in ENDED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


_AMP = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")


def closed_references(html: str) -> str:
    """HTML in which an & that does not begin a whole reference (a known name or a number, with its semicolon) stands for itself."""
    return _AMP.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], html)


def tree(html: str, bare: bool = True) -> Node:
    """bare: references without a semicolon count, as in HTML 5 (`&amp` is `&`); else they are text."""
    parser = _Tree()
    parser.feed(html if bare else closed_references(html))
    parser.close()
    return parser.root


def each_text(f: Callable[[str | None], str | None], texts: str | Column) -> Column:
    """f of each text. Of an Arrow batch, which may be large, few texts at a time become Python strings."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        done = [pa.array([f(x) for x in column.slice(low, 64).to_pylist()], pa.string()) for low in range(0, len(column), 64)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run(texts)


def html_text(html: str | Column, joiner: str = "\n", bare: bool = True) -> Column:
    """The text of HTML: its pieces without white space around them, joined; empty for null. bare: as for tree()."""

    return each_text(lambda h: joiner.join(tree(h, bare).strings()) if h else "", html)


def _signature(dt: Node) -> str:
    return " ".join(dt.strings()).replace("¶", "").strip()


def api_symbols(html: str, filename: str) -> list[tuple[str, str, str, str, str]]:
    """(name, kind, anchor, text, title) of the symbols of an API page, and of each class a summary with its members' signatures."""
    out = []
    for dl in tree(html).all():
        if dl.tag != "dl" or "py" not in dl.classes:
            continue
        heads = dl.children("dt")
        if not heads or not heads[0].attrs.get("id"):
            continue
        name, signature = heads[0].attrs["id"], _signature(heads[0])
        kind = next((c for c in dl.classes if c != "py"), "py")
        body = dl.children("dd")
        about = "\n".join(body[0].strings(without="dl")) if body else ""
        out.append((name, kind, f"{filename}#{name}", f"{signature}\n\n{about}" if about else signature, name))
        if kind == "class":
            inner = [x for x in dl.all() if x.tag == "dl" and "py" in x.classes]
            members = dict.fromkeys(s for x in inner for dt in x.children("dt") if dt.attrs.get("id") and (s := _signature(dt)))
            if members:
                out.append((name, "class_summary", f"{filename}#{name}-summary", signature + "\n\nMembers:\n" + "\n".join(f"- {m}" for m in members), name))
    return out


@udtf(returnType=T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "kind", "anchor", "text", "title")]))
class ApiSymbols:
    """Table function: the symbols of one page (html, filename)."""

    def eval(self, html: str, filename: str):
        if html:
            yield from api_symbols(html, filename)
