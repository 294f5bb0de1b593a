"""Facts of HTML pages: one tolerant parse a page in one Arrow UDF; everything after it is Catalyst expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import spread

#: Elements without content, elements that are taken out before content is read, and where content stands.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PRUNED = frozenset("script style nav header footer aside form".split())
CONTENT_PLACES = (
    ("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "main-content"), ("class", "content"), ("class", "post-content"), ("class", "entry-content"),
    ("class", "article-content"), ("class", "page-content"), ("class", "blog-post"), ("class", "post-body"), ("id", "content"), ("id", "main"), ("class2", "container content"), ("class2", "wrapper content"),
)
LEAST_CONTENT = 10


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """All strings below, stripped, joined by a space."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    out.append(item.strip())
            else:
                stack.extend(reversed(item.children))
        return " ".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def prune(root: Node) -> None:
    """Takes scripts, styles, navigation, headers, footers, asides and forms out of the tree."""
    for node in list(root.walk()):
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag in PRUNED)]


def _matches(node: Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return node.tag == value
    if kind == "class":
        return value in node.classes()
    if kind == "class2":
        outer, inner = value.split()
        up = node.parent
        if inner not in node.classes():
            return False
        while up is not None:
            if outer in up.classes():
                return True
            up = up.parent
        return False
    return node.attrs.get(kind) == value


def main_content(root: Node) -> str:
    """The longest text of the first place that has more than a little; else the body's, else all; nothing if all is little."""
    nodes = list(root.walk())
    for kind, value in CONTENT_PLACES:
        texts = [n.text() for n in nodes if _matches(n, kind, value)]
        if texts and len(best := max(texts, key=len)) > LEAST_CONTENT:
            return best
    for node in (*[n for n in nodes if n.tag == "body"][:1], root):
        if len(text := node.text()) > LEAST_CONTENT:
            return text
    return ""


def _meta(nodes: list[Node], key: str, value: str) -> str | None:
    return next((n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get(key, "").lower() == value), None)


def _linked_types(nodes: list[Node]) -> list[str]:
    found: list[str] = []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                data = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            for item in data if isinstance(data, list) else [data]:
                kind = item.get("@type") if isinstance(item, dict) else None
                found += [str(k) for k in (kind if isinstance(kind, list) else [kind]) if k]
    return found


def _size(value: str | None) -> int | None:
    return int(value) if value and value.strip().isdigit() else None


SCHEMA = (
    "title_tag string, og_title string, tw_title string, h1_text string, description string, og_description string, tw_description string, content string, "
    "headings array<struct<level:int,text:string>>, links array<struct<href:string,text:string,rel:string>>, "
    "images array<struct<src:string,has_alt:boolean,has_title:boolean,width:int,height:int,sized:boolean,lazy:boolean,responsive:boolean>>, "
    "canonical string, robots string, hreflang array<struct<lang:string,url:string>>, ld_types array<string>, viewport string, has_charset boolean, stylesheets int, print_stylesheets int, has_viewport boolean, has_media_queries boolean, compressed boolean, html_bytes long, error string"
)


def facts(html: str | None, pruned: bool = True) -> dict:
    """The facts of one page; never raises, ``error`` tells what went wrong."""
    out: dict = dict.fromkeys(("title_tag", "og_title", "tw_title", "h1_text", "description", "og_description", "tw_description", "canonical", "robots", "viewport", "error"))
    out |= {"content": "", "headings": [], "links": [], "images": [], "hreflang": [], "ld_types": [], "has_charset": False, "stylesheets": 0, "print_stylesheets": 0, "has_viewport": False, "has_media_queries": False, "compressed": False, "html_bytes": len((html or "").encode("utf-8", "surrogatepass"))}
    if not html or not html.strip():
        return out | {"error": "empty page"}
    try:
        root = parse(html)
        nodes = list(root.walk())
        first = lambda tag: next((n.text() for n in nodes if n.tag == tag), None)
        out |= {"title_tag": first("title"), "og_title": _meta(nodes, "property", "og:title"), "tw_title": _meta(nodes, "name", "twitter:title"), "h1_text": first("h1")}
        out |= {"description": _meta(nodes, "name", "description"), "og_description": _meta(nodes, "property", "og:description"), "tw_description": _meta(nodes, "name", "twitter:description")}
        if pruned:
            prune(root)
            nodes = list(root.walk())
        out["content"] = main_content(root)
        out["headings"] = [{"level": int(n.tag[1]), "text": n.text()} for n in nodes if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6")]
        out["links"] = [{"href": n.attrs["href"].strip(), "text": n.text(), "rel": n.attrs.get("rel", "").lower()} for n in nodes if n.tag == "a" and "href" in n.attrs]
        out["images"] = [
            {
                "src": a.get("src") or a.get("data-src") or a.get("data-lazy-src") or "", "has_alt": bool(a.get("alt", "").strip()), "has_title": bool(a.get("title", "").strip()),
                "width": _size(a.get("width")), "height": _size(a.get("height")), "sized": bool(a.get("width")) and bool(a.get("height")),
                "lazy": a.get("loading") == "lazy" or "lazy" in n.classes(), "responsive": bool(a.get("srcset") or a.get("sizes")),
            }
            for n in nodes if n.tag == "img" for a in [n.attrs]
        ]
        links = [n for n in nodes if n.tag == "link"]
        rel = lambda n: n.attrs.get("rel", "").lower().split()
        out["canonical"] = next((n.attrs.get("href") for n in links if "canonical" in rel(n)), None)
        out["hreflang"] = [{"lang": n.attrs["hreflang"], "url": n.attrs.get("href", "")} for n in links if "alternate" in rel(n) and n.attrs.get("hreflang")]
        out |= {"robots": _meta(nodes, "name", "robots"), "viewport": _meta(nodes, "name", "viewport"), "ld_types": _linked_types(nodes)}
        out["has_viewport"] = any(n.tag == "meta" and n.attrs.get("name", "").lower() == "viewport" for n in nodes)
        raw = html.lower()
        out["has_media_queries"], out["compressed"] = "@media" in raw, "gzip" in raw or "deflate" in raw
        out["has_charset"] = any(n.tag == "meta" and ("charset" in n.attrs or n.attrs.get("http-equiv", "").lower() == "content-type") for n in nodes)
        sheets = [n for n in links if "stylesheet" in rel(n)]
        out["stylesheets"], out["print_stylesheets"] = len(sheets), sum("print" in n.attrs.get("media", "").lower() for n in sheets)
    except Exception as e:  # a broken page must not end the batch
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def page_facts(pages: DataFrame, html: str = "html", pruned: bool = True, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(*keep, facts): the facts of every page; null and blank pages have an ``error``, very long ones are parsed whole."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    source = pages.select(*keep, F.col(html).cast("string").alias("__html__"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = pa.struct(list(to_arrow_schema(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(h.as_py(), pruned) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, arrow)], [*keep, "facts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return spread(source).mapInArrow(run, f"{kept}{', ' if kept else ''}facts struct<{schema.simpleString()[7:-1]}>")
