"""Text of HTML mail: hidden parts dropped, lists and tables as Markdown. Lines are kept, for the operators that work by line."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP = {"script", "style", "svg", "head", "title"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {"p", "div", "tr", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "pre"}
#: Widest cell and most rows of a table.
CELL, ROWS = 30, 10


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def hidden(self) -> bool:
        style = re.sub(r"\s", "", self.attrs.get("style", "").lower())
        return self.tag in _DROP or "display:none" in style or "visibility:hidden" in style


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _inner(node: _Node) -> str:
    out = []
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
        elif not part.hidden():
            out.append(_render(part))
    return "".join(out)


def _children(node: _Node, *tags: str) -> list[_Node]:
    found = []
    for part in node.parts:
        if isinstance(part, _Node) and not part.hidden():
            if part.tag in tags:
                found.append(part)
            elif part.tag not in ("table", "ul", "ol"):
                found += _children(part, *tags)
    return found


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _table(node: _Node) -> str:
    rows = [[_flat(_inner(c)) for c in _children(tr, "td", "th")] for tr in _children(node, "tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    head, body = rows[0], [r for r in rows[1:] if r != rows[0]]
    width = len(head)
    line = lambda cells: "| " + " | ".join(c[:CELL] for c in cells) + " |"
    out = [line(head), "|" + "|".join("-" * (len(h[:CELL]) + 2) for h in head) + "|"]
    out += [line((r + [""] * width)[:width]) for r in body[:ROWS]]
    if len(body) > ROWS:
        out.append(f"... ({len(body) - ROWS} more rows)")
    return "\n" + "\n".join(out) + "\n"


def _render(node: _Node) -> str:
    tag = node.tag
    if tag == "br":
        return "\n"
    if tag == "img" or node.hidden():
        return ""
    if tag == "table":
        return _table(node)
    if tag in ("ul", "ol"):
        lines = []
        for n, li in enumerate(_children(node, "li"), 1):
            text = _flat(_inner(li))
            if text:
                lines.append(f"- {text}" if tag == "ul" else f"{n}. {text}")
        return "\n" + "\n".join(lines) + "\n" if lines else ""
    inner = _inner(node)
    return f"\n{inner}\n" if tag in _BLOCK else inner


def to_text(page: str) -> str:
    """Text of a page: hidden parts and pictures dropped, list items as "- x" or "n. x", tables with bars, cut to ROWS rows."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    text = _html.unescape(_inner(tree.root)).replace("\r\n", "\n").replace("\xa0", " ")
    lines = [x.strip() if x.startswith("| ") else re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: to_text(p) if isinstance(p, str) else None)
