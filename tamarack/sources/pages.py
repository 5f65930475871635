"""Fields of raw HTML pages: title, links, media links, main text.

The regular expressions cover markup that is well formed; `main_text_parsed` reads any markup with the standard
library's parser in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import clean, strip
from ..functions.urls import resolve

#: Elements that are no content, and elements that end a line.
DROPPED = ("script", "style", "nav", "header", "footer", "form")
BLOCKS = ("p", "div", "li", "h1", "h2", "h3", "h4", "br", "tr")
ATTRIBUTES = ("href", "src", "data-src", "data", "poster")
CONTENT_CLASSES = ("article-details", "com-content-article__body", "item-page")


def unescape(text: Column) -> Column:
    out = text
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def _inner(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return clean(unescape(F.regexp_replace(inner, r"<[^>]*>", "")))


def title(html: Column) -> Column:
    """The first h1, else the title; empty if there is neither."""
    return F.coalesce(F.nullif(_inner(html, "h1"), F.lit("")), _inner(html, "title"))


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a\s(?:[^>]*?\s)?href="([^"]*)"'), F.lit(1)), unescape)


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row for each link of each page: the page's columns without its markup, and link, the absolute address."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.explode(hrefs(F.col(html))).alias("_href")).withColumn("link", resolve(F.trim("_href"), F.col(url))).drop("_href").filter("link IS NOT NULL")


def media_references(html: Column) -> Column:
    """Values of the attributes that may name a file, the addresses in srcset, and the preview image."""
    every = [F.regexp_extract_all(html, F.lit(rf'(?is)<(?:a|img|source|video|audio|iframe|object)\s(?:[^>]*?\s)?{name}="([^"]*)"'), F.lit(1)) for name in ATTRIBUTES]
    sets = F.regexp_extract_all(html, F.lit(r'(?is)\s(?:data-)?srcset="([^"]*)"'), F.lit(1))
    first = F.flatten(F.transform(sets, lambda s: F.transform(F.split(s, ","), lambda e: F.regexp_extract(F.trim(e), r"^(\S*)", 1))))
    preview = F.regexp_extract_all(html, F.lit(r'(?is)<meta\s[^>]*property="og:image"[^>]*content="([^"]*)"'), F.lit(1))
    return F.filter(F.transform(F.concat(*every, first, preview), unescape), lambda v: v != "")


def preview_image(html: Column, url: Column) -> Column:
    """Absolute address of a page's preview image, null if it names none."""
    own = r'(?is)<meta\s(?=[^>]*property="og:image")[^>]*?content="([^"]*)"'
    found = F.trim(unescape(F.regexp_extract(html, own, 1)))
    return F.when(found != "", resolve(found, url))


def main_text(html: Column) -> Column:
    """Text without what is no content, a line end after each block; elements of DROPPED don't nest in themselves."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?is)<head(?:\s[^>]*)?>.*?</head>", "")
    out = F.regexp_replace(out, rf"(?is)</(?:{'|'.join(BLOCKS)})>|<br\s*/?>", "\n")
    return strip(unescape(F.regexp_replace(out, r"(?s)<[^>]*>", "")))


class _Text(HTMLParser):
    def __init__(self, wanted: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.wanted, self.inside = [], 0, wanted, 0

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag in DROPPED:
            self.skip += 1
        elif self.inside or tag == "main" or any(c in CONTENT_CLASSES for c in classes):
            self.inside += tag not in ("br", "img", "meta", "link", "input", "hr", "source")
        if tag == "br":
            self.out.append((self.inside, "\n"))

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif self.inside:
            self.inside -= 1
        if tag in BLOCKS and not self.skip:
            self.out.append((self.inside + 1, "\n"))

    def handle_data(self, data):
        if not self.skip:
            self.out.append((self.inside, data))


@F.pandas_udf(StringType())
def main_text_parsed(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of the first content element, or of the whole page, of any markup."""

    def one(page: str | None) -> str:
        parser = _Text(True)
        parser.feed(page or "")
        parser.close()
        inner = "".join(t for inside, t in parser.out if inside)
        return (inner if inner.strip() else "".join(t for _, t in parser.out)).strip()

    for series in html:
        yield series.map(one)
