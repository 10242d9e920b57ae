"""Problem 9: cutting oversized texts at natural boundaries.

Sizes are bytes of UTF-8, the tokens of the byte-level tokenizer.  A text is
cut into atomic segments at every boundary; then neighbours are merged, the
pair with the weakest boundary first, as long as both with the overlap fit.
What stays apart are the strongest boundaries that the limit allows to keep.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundaries from the strongest to the weakest; a segment ends where the pattern ends.
BOUNDARIES = (
    ("section", re.compile(r"\n+(?=[ \t]*(?:Phần|Chương|Mục|Điều)[ \t]+[\dIVXLC]+)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…](?:[\"'”’)\]]*)\s+|[。！？]")),
    ("clause", re.compile(r"[;:,](?:\s+)|[，；：、]")),
    ("word", re.compile(r"\s+")),
)
KINDS = tuple(name for name, _ in BOUNDARIES) + ("character",)


def _atoms(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments (in characters) and the rank of the boundary at each end, strongest 0.

    Texts are cut at all boundaries down to sentences, and weaker ones only
    inside a segment that is itself over the limit, so that no cut is made
    where none can be needed.
    """
    rank: dict[int, int] = {}
    for k in range(4):
        for m in BOUNDARIES[k][1].finditer(text):
            rank.setdefault(m.end(), k)
    rank.pop(0, None)
    rank[len(text)] = -1
    ends = sorted(rank)
    out, kinds, begin = [], [], 0
    for end in ends:
        _cut(text, begin, end, rank[end], 4, limit, out, kinds)
        begin = end
    return out, kinds


def _cut(text: str, begin: int, end: int, kind: int, level: int, limit: int, out: list[int], kinds: list[int]) -> None:
    if (end - begin) * 4 > limit and len(text[begin:end].encode()) > limit:
        if level < len(BOUNDARIES):
            at = [m.end() for m in BOUNDARIES[level][1].finditer(text, begin, end) if begin < m.end() < end]
            for cut, k in [*((x, level) for x in at), (end, kind)]:
                _cut(text, begin, cut, k, level + 1, limit, out, kinds)
                begin = cut
            return
        while begin < end:  # no boundary at all: the longest runs of characters that fit
            raw = text[begin : begin + limit].encode()[:limit]
            cut = min(end, begin + len(raw.decode("utf-8", "ignore")))
            if cut <= begin:  # a limit below the size of one character
                cut = begin + 1
            out.append(cut)
            kinds.append(kind if cut == end else level)
            begin = cut
        return
    out.append(end)
    kinds.append(kind)


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces as (core begin, core end, overlap in characters, kind of the boundary at its begin).

    Cores follow one another without gap; piece = overlap before the core + core.
    """
    room = limit - overlap
    ends, kinds = _atoms(text, room)
    begins = [0, *ends[:-1]]
    size = [len(text[a:b].encode()) for a, b in zip(begins, ends)]
    n = len(ends)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    # heap of neighbours by weakness of the boundary, then by their joint size: small scraps join first
    heap = [(-kinds[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, joint, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or size[i] + size[j] != joint:
            continue
        if joint > (limit if i == 0 else room):
            continue
        size[i], ends[i], kinds[i], alive[j] = joint, ends[j], kinds[j], False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            heapq.heappush(heap, (-kinds[i], size[i] + size[nxt[i]], i, nxt[i]))
        if prv[i] >= 0:
            p = prv[i]
            heapq.heappush(heap, (-kinds[p], size[p] + size[i], p, i))
    out, i, before = [], 0, "start"
    while i < n:
        begin = begins[i]
        back = 0
        most = min(overlap, limit - size[i])  # a character may be larger than the room beside the overlap
        if begin and most > 0:
            tail = text[max(0, begin - most) : begin].encode()[-most:]
            back = len(tail.decode("utf-8", "ignore")) if tail else 0
        out.append((begin, ends[i], back, before))
        before = KINDS[kinds[i]] if kinds[i] >= 0 else "end"
        i = nxt[i]
    return out


PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("begin_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("overlap_chars", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("piece_text", T.StringType()),
    ]
)


def split_oversized(texts: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every text above ``limit`` bytes into pieces of at most ``limit`` bytes.

    Returns the key and, per piece, its number from 0, the characters
    [begin_char, end_char) it covers with its overlap, how many of them repeat
    the end of the piece before (as many whole characters as fit ``overlap``
    bytes), the kind of boundary it starts at, its size and its text.  Texts
    within the limit, empty and null texts give no rows.  Rows with the same
    key are cut each on its own.  A limit not above the overlap is refused;
    a limit below one character puts single characters in pieces, and where a
    character leaves no room for the overlap, less is repeated.  Work per
    text is O(n log n), in memory for that text alone.
    """
    if overlap < 0 or limit <= overlap:
        raise ValueError("the limit must be above the overlap")
    rows = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where(F.octet_length("_text") > limit)
    kind = rows.schema["_key"].dataType

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["_key"], b["_text"]):
                for i, (begin, end, back, kind_) in enumerate(pieces_of(t, limit, overlap)):
                    piece = t[begin - back : end]
                    out.append((k, i, begin - back, end, back, kind_, len(piece.encode()), piece))
            yield pd.DataFrame(out, columns=["_key", *PIECE.names])

    return rows.mapInPandas(cut, T.StructType([T.StructField("_key", kind), *PIECE.fields])).withColumnRenamed("_key", key)
