"""Titles, links and texts of HTML pages."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = r'<a\s[^>]*?href="([^"]*)"'
TITLE = r"(?s)<title>(.*?)</title>"
#: Groups of elements in the order in which their texts are joined: (tag, class or None).
SELECTORS = (("h1", "csc-firstHeader"), ("p", "csc-subheader"), ("p", "bodytext"))
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(LINK), F.lit(1))


def raw_title(page: Column) -> Column:
    return F.regexp_extract(page, TITLE, 1)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []
        self.title: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs += [v or "" for k, v in attrs if k == "href"][:1]
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)


def anchors(page: str | None) -> tuple[list[str], str | None]:
    """(href of each link that has one, text of the first title or None), of markup of any case and quotes; character references are resolved."""
    reader = _Anchors()
    reader.feed(page or "")
    reader.close()
    return reader.hrefs, None if reader.title is None else "".join(reader.title)


@F.pandas_udf(T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("title", T.StringType())]))
def parsed(pages: pd.Series) -> pd.DataFrame:
    """links and title of each page, by a parser; for clean pages links() and raw_title() stay in the JVM."""
    found = [anchors(p) for p in pages]
    return pd.DataFrame({"links": [x for x, _ in found], "title": [t for _, t in found]})


def element_texts(page: Column, tag: str) -> Column:
    """Inner HTML of clean, unnested elements, without markup; for messy pages use body_text()."""
    inner = F.regexp_extract_all(page, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: F.regexp_replace(x, r"(?s)<[^>]*>", ""))


class _Reader(HTMLParser):
    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.found = selectors, [], [[] for _ in selectors]

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "p" and any(o[0] == "p" for o in self.open):
            self.handle_endtag("p")
        classes = (dict(attrs).get("class") or "").split()
        hits = [k for k, (t, c) in enumerate(self.selectors) if t == tag and (c is None or c in classes)]
        for k in hits:
            self.found[k].append([])
        self.open.append((tag, [self.found[k][-1] for k in hits]))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if any(o[0] in ("script", "style") for o in self.open):
            return
        for _, targets in self.open:
            for target in targets:
                target.append(data)


def extract(page: str, selectors=SELECTORS) -> str:
    """The texts of the selected elements, group by group, each followed by '. '."""
    reader = _Reader(selectors)
    reader.feed(page or "")
    reader.close()
    return "".join(f"{''.join(x)}. " for group in reader.found for x in group if "".join(x))


def body_text(page: Column, selectors=SELECTORS) -> Column:
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: extract(p, selectors))

    return run(page)
