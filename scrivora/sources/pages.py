"""Articles from HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Text of the heading with an id, and of the paragraphs that are children of a container with a class."""

    def __init__(self, heading: str, container: str):
        super().__init__(convert_charrefs=True)
        self.heading, self.container = heading, container
        self.open: list[tuple[str, str]] = []
        self.title: list[str] | None = None
        self.titled = False
        self.paragraph: list[str] | None = None
        self.paragraphs: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        # An open paragraph ends where another block begins.
        if tag in ("p", "div", "h1", "h2", "h3", "ul", "ol", "table", "section") and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")
        given = dict(attrs)
        mark = ""
        if tag == "h1" and given.get("id") == self.heading and not self.titled:
            self.title, mark = [], "title"
        elif tag == "div" and self.container in (given.get("class") or "").split():
            mark = "container"
        elif tag == "p" and self.open and self.open[-1][1] == "container":
            self.paragraph, mark = [], "paragraph"
        elif tag in ("script", "style"):
            self.skipped += 1
            mark = "skip"
        self.open.append((tag, mark))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, mark = self.open.pop()
            if mark == "title":
                self.titled = True
            elif mark == "paragraph":
                self._close()
            elif mark == "skip":
                self.skipped -= 1
            if t == tag:
                return

    def _close(self):
        text = "".join(self.paragraph or [])
        if text.strip():
            self.paragraphs.append(text)
        self.paragraph = None

    def handle_data(self, data):
        if self.skipped:
            return
        if self.title is not None and not self.titled:
            self.title.append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)


def read_page(html: str | None, heading: str = "firstHeading", container: str = "mw-parser-output") -> tuple[str | None, str]:
    reader = _Reader(heading, container)
    reader.feed(html or "")
    reader.close()
    if reader.paragraph is not None:
        reader._close()
    return None if reader.title is None else "".join(reader.title), "\n".join(reader.paragraphs)


def parse_pages(pages: DataFrame, html_col: str = "html", heading: str = "firstHeading", container: str = "mw-parser-output") -> DataFrame:
    """``pages`` with ``title`` and ``text`` read from the HTML instead of its column; pages without heading or without a
    paragraph that is not blank give no row. Null and empty pages give none either."""
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "title", "text")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(h, heading, container) for h in batch[html_col]]
            out = batch[[f.name for f in kept]].assign(title=[t for t, _ in found], text=[x for _, x in found])
            yield out[out["title"].notna() & (out["text"] != "")]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    slim = pages.select(*[f.name for f in kept], html_col).where(F.col(html_col).isNotNull())
    return slim.mapInPandas(read, f"{schema}{', ' if schema else ''}title string, text string")


def paragraphs(text_col: str = "text"):
    """The paragraphs of a text that are not blank, joined by line feeds."""
    return F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda p: F.trim(p) != ""), "\n")
