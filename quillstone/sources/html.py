"""HTML pages as ordered text blocks and tables, on html.parser."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements read as blocks, headings, leaf containers, elements left out, elements without an end.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li")
LEAVES = ("div", "span")
SILENT = ("script", "style", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
REFERENCE = re.compile(r"&(?:([A-Za-z][A-Za-z0-9]*;)|#(?:[0-9]+|[xX][0-9A-Fa-f]+);)?")
ENDS = {"p": (*BLOCKS, "div", "table", "ul", "ol"), "li": ("li",), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}


class _Node:
    __slots__ = ("kids", "order", "parent", "tag", "attrs")

    def __init__(self, tag, parent, order, attrs=()):
        self.tag, self.parent, self.order, self.kids, self.attrs = tag, parent, order, [], dict(attrs)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.kids)
        return " ".join("".join(out).split())

    def below(self):
        todo = list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if not isinstance(x, str):
                yield x
                todo += reversed(x.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None, 0)
        self.count = self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            return
        if self.at.tag in ENDS and tag in ENDS[self.at.tag]:
            self.at = self.at.parent
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.parent
        self.count += 1
        node = _Node(tag, self.at, self.count, attrs)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.count += 1
            self.at.kids.append(_Node(tag, self.at, self.count, attrs))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        if not self.silent:
            self.at.kids.append(data)


def _matrix(table: _Node) -> list[list[str]]:
    out = []
    for row in (x for x in table.below() if x.tag == "tr"):
        cells = [x for x in row.kids if not isinstance(x, str) and x.tag in ("td", "th")]
        values = []
        for c in cells:
            span = str(c.attrs.get("colspan") or "1")
            values += [c.text()] * max(1, int(span) if span.isdigit() else 1)
        if any(values):
            out.append(values)
    return out


def _whole_references(html: str) -> str:
    """html with each & that begins no known reference ended by a semicolon written as one that stands for itself."""

    def kept(m: re.Match) -> str:
        whole = len(m[0]) > 1 and (m[1] is None or m[1] in html5)
        return m[0] if whole else "&amp;" + m[0][1:]

    return REFERENCE.sub(kept, html)


def parse_page(html: str | None, document: str, once: bool = True, whole_references: bool = False) -> list[dict]:
    """Records of a page in order: blocks of two characters or more, each text once, and tables of two rows and columns or more.

    Tables are numbered whether they are kept or not; a table takes the last heading as its title. Without once every block
    is a record; with whole_references a reference that has lost its semicolon stays as it is written.
    """
    tree = _Tree()
    tree.feed(_whole_references(html or "") if whole_references else html or "")
    tree.close()
    out, seen, blocks, tables, heading = [], set(), 0, 0, ""
    todo: list[tuple[_Node, bool]] = [(tree.root, False)]
    while todo:
        node, inside = todo.pop()
        tag = node.tag
        if tag == "table":
            tables += 1
            m = _matrix(node)
            if len(m) >= 2 and max(map(len, m)) >= 2:
                out.append({"record_type": "table", "source_format": "html", "table_id": f"{document}_table_{tables:04d}", "table_title": heading, "raw_matrix": m, "header_rows": m[:1], "html_order": node.order, "source_location": f"html_table={tables}"})
        elif not inside and (tag in BLOCKS or (tag in LEAVES and not any(x.tag in (*BLOCKS, "table") for x in node.below()))):
            text = node.text()
            if len(text) >= 2 and not (once and text in seen):
                seen.add(text)
                blocks += 1
                if tag in HEADINGS:
                    heading = text
                out.append({"record_type": "text", "source_format": "html", "content_role": "heading" if tag in HEADINGS else "paragraph", "raw_text": text, "html_order": node.order, "block_ordinal": blocks, "source_location": f"html_block={blocks}"})
        closed = inside or tag in BLOCKS or tag == "table"
        todo += [(k, closed) for k in reversed(node.kids) if not isinstance(k, str)]
    return out


SCHEMA = "document string, html_order int, record_type string, content_role string, text string, table_id string, table_title string, matrix array<array<string>>"


def parse_pages(pages: DataFrame, document: str = "url", html: str = "html", once: bool = True, whole_references: bool = False) -> DataFrame:
    """Records of a table of pages, typed; once and whole_references as in parse_page()."""

    def run(batches):
        for pdf in batches:
            rows = [
                (d, r["html_order"], r["record_type"], r.get("content_role"), r.get("raw_text"), r.get("table_id"), r.get("table_title"), r.get("raw_matrix"))
                for d, h in zip(pdf["d"], pdf["h"], strict=True)
                for r in parse_page(h, d, once, whole_references)
            ]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return pages.select(F.col(document).cast("string").alias("d"), F.col(html).alias("h")).mapInPandas(run, SCHEMA)


def distinct_blocks(blocks: DataFrame, document: str = "document", text: str = "text", order: str = "html_order") -> DataFrame:
    """The first block of each text of a document."""
    w = Window.partitionBy(document, F.sha1(text)).orderBy(order)
    return blocks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

