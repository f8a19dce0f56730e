"""Nodes of stored HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Elements that have no end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def links(html: Column) -> Column:
    """``href`` values of anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


class _Collector(HTMLParser):
    """Text and markup of the elements a ``tag.class#id`` path of ancestors selects."""

    def __init__(self, steps: list[tuple[str, set, str]]) -> None:
        super().__init__(convert_charrefs=True)
        self.steps, self.stack, self.open, self.found = steps, [], [], []

    def run(self, page: str) -> list[dict]:
        self.page, self.lines = page, [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        self._end(0, len(page))
        return self.found

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, depth: int, place: int) -> None:
        """Elements deeper than ``depth`` end at a place of the page."""
        for d, n in self.open:
            if d > depth:
                self.found[n]["markup"] = self.page[self.found[n].pop("from"):place]
        self.open = [(d, n) for d, n in self.open if d <= depth]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.stack.append((tag, set(a.get("class", "").split()), a.get("id", "")))
        if self._selected():
            self.found.append({"tag": tag, "id": a.get("id"), "classes": a.get("class"), "text": "",
                               "from": self._place() + len(self.get_starttag_text())})
            self.open.append((len(self.stack), len(self.found) - 1))
        if tag in _VOID:
            self._pop(tag, self._place() + len(self.get_starttag_text()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop(tag, self._place() + len(self.get_starttag_text()))

    def handle_endtag(self, tag):
        self._pop(tag, self._place())

    def _pop(self, tag: str, place: int) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        self._end(len(self.stack), place)

    def handle_data(self, data):
        for _, n in self.open:
            self.found[n]["text"] += data

    def _selected(self) -> bool:
        def fits(node, step):
            return (not step[0] or node[0] == step[0]) and step[1] <= node[1] and (not step[2] or node[2] == step[2])

        if not fits(self.stack[-1], self.steps[-1]):
            return False
        want = list(self.steps[:-1])
        for node in reversed(self.stack[:-1]):
            if want and fits(node, want[-1]):
                want.pop()
        return not want


def _steps(selector: str) -> list[tuple[str, set, str]]:
    out = []
    for part in selector.split():
        tag = re.match(r"[\w-]*", part)[0]
        ids = re.findall(r"#([\w-]+)", part)
        out.append((tag, set(re.findall(r"\.([\w-]+)", part)), ids[0] if ids else ""))
    return out


def select_nodes(pages: DataFrame, selector: str, html: str = "html") -> DataFrame:
    """One row per node a descendant selector (``div.item a``) picks: adds ``pos, tag, node_id, classes, text, markup``.

    ``text`` has its entities resolved; ``markup`` is what stands between the node's tags, as it is written.
    """
    steps = _steps(selector)

    @F.pandas_udf("array<struct<tag:string,id:string,classes:string,text:string,markup:string>>")
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda page: _Collector(steps).run(page or ""))

    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(nodes(F.col(html))).alias("pos", "node")).select(
        *rest, "pos", F.col("node.tag").alias("tag"), F.col("node.id").alias("node_id"),
        F.col("node.classes").alias("classes"), F.col("node.text").alias("text"),
        F.col("node.markup").alias("markup"))
