"""One pass of the standard HTML parser over a page, for what Spark's functions cannot take out of HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.functions import text as X

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Selectors of a page's title, date and author, in the order in which they are tried (fixed values).
TITLE_SELECTORS = (".Article_Title", ".News-title", "h1", ".article-title", "[class*=title]")
DATE_SELECTORS = (".Article_PublishDate", ".publish-date", ".date", "time")
AUTHOR_SELECTORS = (".author", ".Article_Author", ".writer")
#: Attributes that tables keep, and icons that go (fixed values).
TABLE_ATTRIBUTES = ("rowspan", "colspan", "align", "href", "src", "alt", "title")
ICONS = ("icon_pdf.gif", "icon_xls.gif", "icon_doc.gif")
PDF_LABEL = "PDF文档"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, without: tuple[str, ...] = ()):
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in without:
                todo += reversed(node.children)


class Tree(HTMLParser):
    """Builds nodes; an end tag closes the nearest open element of its name, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str | None) -> Node:
    tree = Tree()
    tree.feed(text or "")
    tree.close()
    return tree.root


def spaced(text: str) -> str:
    return " ".join(text.split())


def matches(node: Node, selector: str) -> bool:
    classes = node.attrs.get("class", "")
    if selector.startswith("."):
        return selector[1:] in classes.split()
    if selector.startswith("[class*="):
        return selector[8:-1] in classes
    return node.tag == selector


def first_text(root: Node, selectors: tuple[str, ...]) -> str:
    """Text of the first element of the first selector whose first element has text."""
    for selector in selectors:
        node = next((n for n in root.walk() if n.tag and matches(n, selector)), None)
        if node is not None and (text := spaced("".join(s.strip() for s in node.strings()))):
            return text
    return ""


@F.pandas_udf(T.StringType())
def strip_html(pages: pd.Series) -> pd.Series:
    """Text of HTML without scripts and styles, pieces joined by single spaces; null gives ''."""
    return pages.map(lambda x: spaced(" ".join(parse(x).strings(("script", "style")))) if x else "")


def page_metadata(html: Column | str, title: tuple[str, ...] = TITLE_SELECTORS, date: tuple[str, ...] = DATE_SELECTORS, author: tuple[str, ...] = AUTHOR_SELECTORS) -> Column:
    """Of a column of HTML: title (or else that of <title>), date and author of a page; '' for what it lacks."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "date", "author")]))
    def found(pages: pd.Series) -> pd.DataFrame:
        roots = [parse(page) for page in pages]
        return pd.DataFrame({"title": [first_text(r, (*title, "title")) for r in roots], "date": [first_text(r, date) for r in roots], "author": [first_text(r, author) for r in roots]}, dtype=object)

    return found(html)


def written(node: Node) -> str:
    """HTML of a table's element with the attributes to keep, without icons."""
    out = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(html.escape(x, quote=False))
        elif not (x.tag == "img" and x.attrs.get("src", "").endswith(ICONS)):
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items() if k in TABLE_ATTRIBUTES)
            out.append(f"<{x.tag}{attrs}/>" if x.tag in VOID else f"<{x.tag}{attrs}>")
            if x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
                todo += reversed(x.children)
    return "".join(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def complex_tables(pages: pd.Series) -> pd.Series:
    """The tables of a page that have cells over several rows or columns, cleaned."""
    out = []
    for page in pages:
        tables = [n for n in parse(page).walk() if n.tag == "table"] if page and "<table" in page.lower() else []
        out.append([written(t) for t in tables if any(c.tag in ("td", "th") and ("rowspan" in c.attrs or "colspan" in c.attrs) for c in t.walk())])
    return pd.Series(out, dtype=object)


def shown_file(frame: Node) -> str | None:
    """The address of the file that a viewer frame shows, with its escapes undone; null for any other element."""
    source = frame.attrs.get("src", "")
    if frame.tag == "iframe" and "wp_pdf_player" in frame.attrs.get("class", "") and "viewer.html" in source:
        named = re.search(r'file=([^&"]+)', source)
        return unquote(named[1]) if named else None
    return None


def file_label(frame: Node, address: str) -> str:
    return frame.attrs.get("title") or address.rsplit("/", 1)[-1].replace(".pdf", "") or PDF_LABEL


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "label")])))
def pdf_links(pages: pd.Series, urls: pd.Series) -> pd.Series:
    """Address and label of the PDF files that a page shows in a viewer; a path gets the page's scheme and host."""
    host = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")

    def links(page: str | None, url: str | None) -> list[dict]:
        nodes = list(parse(page).walk()) if page and "<iframe" in page.lower() else []
        shown = [(n, a) for n, a in zip(nodes, map(shown_file, nodes), strict=True) if a is not None]
        base = host.match(url or "")
        whole = [(n, (base[0] if base else "") + a if a.startswith("/") else a) for n, a in shown]
        return [{"url": a, "label": file_label(n, a)} for n, a in whole]

    return pd.Series([links(p, u) for p, u in zip(pages, urls, strict=True)], dtype=object)


#: Lines of the head in which the date is looked for, and rows from which on a table of links is one for navigation (fixed values).
HEAD_LINES, NAVIGATION_ROWS = 5, 4


def clean_article_markdown(text: Column, title: Column, date: Column) -> Column:
    """Markdown without the title and date lines at its head, navigation tables and repeated dates, by what each line is and how long its run of bars is.

    The head is the lines before the first that is neither blank, nor a rule of bars and dashes, nor holds the title, nor (in the first HEAD_LINES lines) the
    date. A navigation table is a line of two bars first and the run of lines of a bar that follows, if these are NAVIGATION_ROWS or more. Null text gives ''.
    """
    title, date = F.coalesce(title, F.lit("")), F.coalesce(date, F.lit(""))

    def marks(line: Column, n: Column) -> Column:
        s = X.strip(line)
        head = (s == "") | s.rlike(r"\A[|\-]+\z") | ((title != "") & F.contains(s, title)) | ((date != "") & F.contains(s, date) & (n < HEAD_LINES))
        dated = (s == date) | (s == F.concat(F.lit("|  "), date, F.lit("  |")))
        return F.struct(line.alias("line"), n.alias("n"), head.alias("head"), s.startswith("|").alias("bar"), s.startswith("|  |").alias("opens"), dated.alias("dated"))

    def body(all_lines: Column) -> Column:
        begin = F.try_element_at(F.filter(all_lines, lambda x: ~x["head"]), F.lit(1))["n"]
        return F.filter(all_lines, lambda x: x["n"] >= begin)

    def kept(lines: Column) -> Column:
        # Where each line's run of bars ends: the first line after it without a bar. A line that opens a table takes its run with it.
        plain = F.transform(F.filter(lines, lambda x: ~x["bar"]), lambda x: x["n"])
        last = F.try_element_at(lines, F.lit(-1))["n"] + 1
        end = lambda x: F.coalesce(F.array_min(F.filter(plain, lambda n: n > x["n"])), last)
        tables = F.transform(F.filter(lines, lambda x: x["opens"]), lambda x: F.struct(x["n"].alias("a"), end(x).alias("b")))
        tables = F.filter(tables, lambda t: t["b"] - t["a"] - 1 >= NAVIGATION_ROWS)
        inside = lambda x: F.exists(tables, lambda t: (t["a"] <= x["n"]) & (x["n"] < t["b"]))
        return F.transform(F.filter(lines, lambda x: ~inside(x) & ~x["dated"]), lambda x: x["line"])

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), marks)
    joined = X.let(lines, lambda found: X.let(body(found), lambda rest: F.array_join(kept(rest), "\n")))
    return X.strip(F.coalesce(joined, F.lit("")))
