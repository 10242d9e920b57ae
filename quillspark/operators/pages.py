"""Stored pages: the main part, its title, its blocks in order, captions of tables and links to forms."""

from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where the main part of a page may be, in order of preference (# an id, . a class).
MAIN_PARTS = ("#toanvancontent", ".fulltext", "#divContentDoc", "#divNoiDung", "#divFullText", "#divContent", ".content1", ".contentdoc", ".content-doc", ".vanban-content", ".news-content", ".content-detail")
# Where its title may be.
TITLES = ("h1", "h2", ".title", ".vb-title", ".doc-title", ".news-title")
# What is no content, and how many characters the longest part must have to be taken without a name.
NO_CONTENT = frozenset(("script", "style", "noscript", "iframe", "form"))
LEAST_PART = 500
# First words of titles, articles and forms, and of the line before a table that is its caption.
TITLE_WORDS = re.compile(r"(?:luật|bộ luật|nghị định|nghị quyết|quyết định|thông tư|pháp lệnh)\b", re.I)
ARTICLE_WORDS = re.compile(r"[“\"]?điều\s+\d+[a-z]?\b", re.I)
FORM_WORDS = re.compile(r"(?:Mẫu số|MẪU SỐ)\b")
CAPTION_WORDS = ("bảng", "biểu")
# Longest title of a page, and of a form or table.
MOST_TITLE, MOST_CAPTION = 1500, 1000

_ALONE = frozenset(("br", "hr", "img", "input", "meta", "link", "col", "wbr"))
_ENDS_PARAGRAPH = frozenset(("p", "div", "table", "h1", "h2", "h3", "ul", "ol", "section", "article"))


class _Page(HTMLParser):
    """Elements in document order, each with the pieces of text and the elements it holds."""

    def __init__(self, source: str):
        super().__init__()
        self.tags: list[str] = []
        self.attributes: list[dict] = []
        self.first_text: list[int] = []
        self.last_text: list[int] = []
        self.last: list[int] = []
        self.texts: list[str] = []
        self.shared_title: str | None = None
        self._open: list[int] = []
        self._hidden = 0
        self.feed(source)
        self.close()
        self._close_down_to(0)

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and dict(attrs).get("property") == "og:title":
            self.shared_title = self.shared_title or dict(attrs).get("content")
        if tag in _ALONE:
            return
        if tag in _ENDS_PARAGRAPH and self._open and self.tags[self._open[-1]] == "p":
            self._close_down_to(len(self._open) - 1)
        self._open.append(len(self.tags))
        self._hidden += tag in NO_CONTENT
        self.tags.append(tag)
        self.attributes.append(dict(attrs))
        self.first_text.append(len(self.texts))
        self.last_text.append(-1)
        self.last.append(-1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _ALONE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self._open) - 1, -1, -1) if self.tags[self._open[i]] == tag), None)
        if depth is not None:
            self._close_down_to(depth)

    def handle_data(self, data):
        if not self._hidden:
            self.texts.append(data)

    def _close_down_to(self, depth: int) -> None:
        for i in self._open[depth:]:
            self.last_text[i], self.last[i] = len(self.texts), len(self.tags)
            self._hidden -= self.tags[i] in NO_CONTENT
        del self._open[depth:]

    def text(self, i: int) -> str:
        return " ".join(" ".join(self.texts[self.first_text[i] : self.last_text[i]]).split())

    def named(self, selector: str) -> list[int]:
        def fits(i: int) -> bool:
            if selector[0] == "#":
                return self.attributes[i].get("id") == selector[1:]
            if selector[0] == ".":
                return selector[1:] in (self.attributes[i].get("class") or "").split()
            return self.tags[i] == selector

        return [i for i in range(len(self.tags)) if fits(i)]

    def main_part(self) -> range:
        """The elements of the main part: a named one with text, else the longest, else all."""
        for selector in MAIN_PARTS:
            for i in self.named(selector)[:1]:
                if self.text(i):
                    return range(i, self.last[i])
        upto = [0, *itertools.accumulate(len(" ".join(t.split())) for t in self.texts)]
        parts = [(upto[self.last_text[i]] - upto[self.first_text[i]], -i) for i, tag in enumerate(self.tags) if tag in ("article", "section", "div")]
        size, at = max(parts, default=(0, 0))
        return range(-at, self.last[-at]) if size >= LEAST_PART else range(len(self.tags))

    def blocks(self, part: range) -> list[dict]:
        out, inner = [], len(self.tags)  # the next paragraph or table
        divided = set()
        for i in reversed(part):
            if inner < self.last[i]:
                divided.add(i)
            if self.tags[i] in ("p", "table"):
                inner = i
        for i in part:
            tag = self.tags[i]
            if tag not in ("p", "table", "div") or tag == "div" and i in divided:
                continue
            if (text := self.text(i)) or tag == "table":
                out.append({"tag": tag, "text": text, "caption": self.caption(i) if tag == "table" else None})
        return out

    def caption(self, i: int) -> str | None:
        for j in range(i + 1, self.last[i]):
            if self.tags[j] == "caption":
                return self.text(j)[:MOST_CAPTION] or None
        before = next((self.text(j) for j in range(i - 1, -1, -1) if self.tags[j] in ("p", "div")), "")
        return before[:MOST_CAPTION] if before.lower().startswith(CAPTION_WORDS) else None

    def forms(self, part: range) -> list[dict]:
        out = []
        for i in part:
            if self.tags[i] == "a":
                text, to = self.text(i), self.attributes[i].get("href")
                if FORM_WORDS.match(text) or "mau" in (to or "").lower():
                    out.append({"title": text[:MOST_CAPTION] or None, "url": to})
        return out

    def title(self, part: range, blocks: list[dict]) -> str | None:
        for selector in TITLES:
            for i in self.named(selector)[:1]:
                if text := self.text(i):
                    return text[:MOST_TITLE]
        bold = next((self.text(i) for i in part if self.tags[i] in ("b", "strong")), "")
        if bold and not ARTICLE_WORDS.match(bold):
            return bold[:MOST_TITLE]
        named = next((b["text"] for b in blocks if TITLE_WORDS.match(b["text"])), None)
        outer = next((self.text(i) for i in self.named("title")), None)
        found = named or (self.shared_title or "").strip() or outer
        return found[:MOST_TITLE] if found else None


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(_texts("tag", "text", "caption"))), T.StructField("forms", T.ArrayType(_texts("title", "url")))]))
def _read(sources: pd.Series) -> pd.DataFrame:
    out = []
    for source in sources:
        page = _Page(source or "")
        part = page.main_part()
        blocks = page.blocks(part)
        out.append((page.title(part, blocks), blocks, page.forms(part)))
    return pd.DataFrame(out, columns=["title", "blocks", "forms"])


def page(source: Column) -> Column:
    """``title, blocks, forms`` of a page of HTML; null and empty pages have no title and empty lists.

    Blocks are the paragraphs, tables and undivided parts of the main part in
    order, empty ones but tables left out, tables with the caption they hold or
    the line before that names them.  The text of a table holds its caption.  Forms are links called so.
    """
    return _read(source)


def page_blocks(rows: DataFrame, key: str, source: str) -> DataFrame:
    """``<key>, pos, tag, text, caption``: the blocks of each page, counted from 0."""
    read = rows.select(F.col(key), page(F.col(source)).alias("_page"))
    return read.select(key, F.posexplode("_page.blocks").alias("pos", "_b")).select(key, "pos", "_b.*")


def page_forms(rows: DataFrame, key: str, source: str) -> DataFrame:
    """``<key>, anchor, title, url``: the links to forms of each page, counted from 1 in their anchors."""
    read = rows.select(F.col(key), page(F.col(source)).alias("_page"))
    return read.select(key, F.posexplode("_page.forms").alias("_at", "_f")).select(key, F.concat(F.lit("form-"), (F.col("_at") + 1).cast("string")).alias("anchor"), "_f.*")
