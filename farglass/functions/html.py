"""HTML fragments: text of chosen tags, and character references."""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Segments(HTMLParser):
    def __init__(self, tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.open, self.out = tags, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.tags:
            self.open.append((tag, len(self.out)))
            self.out.append("")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        for _, k in self.open:
            self.out[k] += data


def segments(html: str | None, tags: Sequence[str]) -> list[str]:
    """Texts of the tags' elements in page order; an element inside another is in both."""
    parser = _Segments(frozenset(tags))
    parser.feed(html or "")
    parser.close()
    return [x.strip() for x in parser.out if x.strip()]


def tag_texts(html: Column, tags: Sequence[str] = ("p",)) -> Column:
    """Array of the texts of the chosen tags; null gives an empty array.

    Markup needs a parser, which built-in functions lack, so this runs in Python, a batch at a time.
    """

    @F.pandas_udf("array<string>")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: segments(x, tags))

    return extract(F.coalesce(html, F.lit("")))


def decode_references(text: Column) -> Column:
    """Character references decoded, as HTML does it: ``&amp`` needs no semicolon, ``&am`` is text.

    Texts that hold no others than the five of XML, each with its semicolon, are decoded on the JVM's
    side; only the rest is sent to Python (nulls stand for the others).
    """

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(unescape, na_action="ignore")

    plain = text
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    simple = text.rlike("^(?:[^&]|&(?:lt|gt|quot|#39|amp);)*+$")
    return F.when(simple, plain).otherwise(decode(F.when(~simple, text)))
