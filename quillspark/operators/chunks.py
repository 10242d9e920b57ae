"""Cutting legal texts into chunks along their structure, or into windows.

All boundaries of a text are found in one scan.  They become a table of spans:
where each begins, how deep it stands and where the next one as deep begins.
Chunks are rows of that table; pieces of long ones end at cut places found by
binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings from the widest level to the narrowest, beginnings of headings, clauses and points, and places to cut a window.
LEVELS = ("Phần", "Chương", "Mục", "Tiểu mục", "Điều")
BOUNDARY = re.compile(r"^(?:(?P<level>Phần|Chương|Mục|Tiểu mục|Điều)\s+(?P<number>[IVXLCDM\d]+[A-ZĐ]?(?:[./-]\d+)*)\b[^\n]*|(?P<clause>\d+)\.\s+|(?P<point>[a-zđ])\)\s+)", re.M)
CUT = re.compile(r"\n|[.;] ")

ARTICLE, CLAUSE, POINT = 4, 5, 6


class Spans(NamedTuple):
    """Boundaries in order: begin, depth (0 to 4 headings, 5 clauses, 6 points), end, label and heading line."""

    begin: np.ndarray
    depth: np.ndarray
    end: np.ndarray
    label: list[str]
    line: list[str]


class Piece(NamedTuple):
    """A row of CHUNK without its index."""

    begin: int
    end: int
    text: str
    level: str
    path: str
    article: str | None
    clause: str | None
    point: str | None
    parent: str | None


def tidy(text: str) -> str:
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def spans_of(text: str) -> Spans:
    """The table of boundaries; a heading ends at the next heading, a clause also at a clause, a point also at a point."""
    begin, depth, label, line = [], [], [], []
    for m in BOUNDARY.finditer(text):
        level = m["level"]
        begin.append(m.start())
        depth.append(LEVELS.index(level) if level else CLAUSE if m["clause"] else POINT)
        label.append(m["number"] or m["clause"] or m["point"])
        line.append(m[0].strip())
    at, deep = np.array(begin, dtype=np.int64), np.array(depth, dtype=np.int64)
    end = np.full(len(at), len(text), dtype=np.int64)
    for reach in (ARTICLE, CLAUSE, POINT):
        stops = np.append(at[deep <= reach], len(text))
        own = deep == reach if reach > ARTICLE else deep <= ARTICLE
        end[own] = stops[np.searchsorted(stops, at[own], side="right")]
    return Spans(at, deep, end, label, line)


def paths(spans: Spans) -> list[str]:
    """Of each boundary the headings it stands under: of every level the last one, if no wider heading came after it."""
    order = np.arange(len(spans.begin))
    last = np.stack([np.maximum.accumulate(np.where(spans.depth == level, order, -1)) for level in range(len(LEVELS))]) if len(order) else np.zeros((len(LEVELS), 0), dtype=np.int64)
    widest = np.maximum.accumulate(last, axis=0)
    holds = (last == widest) & (last >= 0)
    return [" > ".join(spans.line[j] for j, ok in zip(last[:, i], holds[:, i]) if ok) for i in order]


def windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Stretches of at most ``size`` signs, cut at the last good place in their second half; each starts before the end of the last and after its start."""
    found = [(m.start(), m.end()) for m in CUT.finditer(text)]
    starts, needs = (np.array([x[i] for x in found], dtype=np.int64) for i in (0, 1))
    out: list[tuple[int, int]] = []
    begin = 0
    while text and (not out or out[-1][1] < len(text)):
        end = min(begin + size, len(text))
        at = int(np.searchsorted(needs, end, side="right")) - 1
        if end < len(text) and at >= 0 and starts[at] - begin > size // 2:
            end = int(starts[at]) + 1
        out.append((begin, end))
        begin = max(begin + 1, end - overlap)
    return out


def _rows(text: str, begin: int, end: int, size: int, overlap: int, attributes: tuple) -> Iterator[tuple]:
    """One chunk row, or its windows where the text is longer than ``size``; ``begin`` is where the text stands."""
    if len(text.strip()) <= size and attributes[0] != "window":
        yield (begin, end, text.strip(), *attributes)
        return
    for a, b in windows(text, size, overlap):
        if part := text[a:b].strip():
            yield (begin + a, begin + b, part, *attributes)


def structure(text: str, size: int = 1500, overlap: int = 200) -> list[Piece]:
    """Chunks of one tidy text.

    An article with clauses or points is a parent and its narrowest units are
    children that begin with its heading; other sections are chunks of their
    own, and a text without headings is cut into windows.
    """
    return [Piece(*row) for row in _structured(text, size, overlap)]


def _structured(text: str, size: int, overlap: int) -> Iterator[tuple]:
    spans = spans_of(text)
    heads = np.flatnonzero(spans.depth <= ARTICLE)
    if not len(heads):
        yield from _rows(text, 0, len(text), size, overlap, ("window", "", None, None, None, None))
        return
    path = paths(spans)
    # boundaries under each heading stand between it and the next one
    for i, upto in zip(heads, [*heads[1:], len(spans.begin)]):
        begin, end = int(spans.begin[i]), int(spans.end[i])
        article = spans.label[i] if spans.depth[i] == ARTICLE else None
        under = np.arange(i + 1, upto) if article else np.zeros(0, dtype=np.int64)
        clauses = under[spans.depth[under] == CLAUSE]
        points = under[spans.depth[under] == POINT]
        # points before the first clause belong to none and are left to the parent
        owner = np.searchsorted(clauses, points) - 1
        units = [(None, p) for p in points] if not len(clauses) else []
        for k, c in enumerate(clauses):
            units += [(c, p) for p in points[owner == k]] or [(c, None)]
        if not units:
            yield from _rows(text[begin:end], begin, end, size, overlap, ("section", path[i], article, None, None, None))
            continue
        parent = f"article:{article}:{begin}"
        yield begin, end, text[begin:end].strip(), "parent", path[i], article, None, None, parent
        for c, p in units:
            at = c if p is None else p
            a, b = int(spans.begin[at]), int(spans.end[at])
            part = f"{spans.line[i]}\n{text[a:b].strip()}"
            attributes = ("child", path[i], article, None if c is None else spans.label[c], None if p is None else spans.label[p], parent)
            if len(part) <= size:
                yield a, b, part, *attributes
            else:
                yield from _rows(part, a, b, size, overlap, attributes)


CHUNK = "chunk_index int, begin_char long, end_char long, chunk_text string, level string, path string, article string, clause string, point string, parent_key string"


def chunk(texts: DataFrame, key: str, text: str, *, size: int = 1500, overlap: int = 200, structured: bool = True) -> DataFrame:
    """Chunks of every text: the key and the columns of CHUNK. Null and blank texts give none; rows of one key are cut each on its own."""
    if size <= overlap:
        raise ValueError("the size must be above the overlap")
    rows = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_text is not null")
    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), *T.StructType.fromDDL(CHUNK).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["_key"], b["_text"]):
                t = tidy(t)
                rows = structure(t, size, overlap) if structured else _rows(t, 0, len(t), size, overlap, ("window", "", None, None, None, None))
                out += [(k, i, *row) for i, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)


def hydrate(chunks: DataFrame, key: str) -> DataFrame:
    """Adds ``context_text``: of a child the text of its parent, else its own."""
    parents = chunks.where("level = 'parent'").groupBy(key, "parent_key").agg(F.max_by("chunk_text", "chunk_index").alias("_parent"))
    return chunks.join(parents, [key, "parent_key"], "left").withColumn("context_text", F.when((F.col("level") == "child") & (F.length("_parent") > 0), F.col("_parent")).otherwise(F.col("chunk_text"))).drop("_parent")
