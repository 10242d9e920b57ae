"""Problem 1: noise in text from scanned pages.

Lines are cleared of page numbers and running headers, words broken over line
ends are joined, and lines are put together into paragraphs.  Misread words are
found against a vocabulary taken from the whole collection: a Levenshtein
automaton of each word walks tries of the words that are much more frequent,
which gives every candidate within the distance; candidates that the known
misreadings explain are ranked by the words next to them.  The vocabulary is cut
into one trie for each first letter and length, and words go to the tries that
their explained candidates can be in, so that no task or driver holds all of it.
All thresholds are shares or fixed numbers: none moves with the collection.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: How many times as frequent a word must be as what it may have been read as.
DOMINANCE = 20
#: How many times as frequent it must be for a reading to show by itself that a text was misread.
SURE = 400
#: Frequent words without candidates that all tasks pass over; a longer list saves work and changes nothing.
PASSED_WORDS = 50_000
#: Words that one task looks up in one trie.
LOT = 5_000
#: Chance that one sign is misread, or an accent changed, beside that of a word read rightly; and of any word beside another one.
SIGN_CHANCE, ACCENT_CHANCE = 0.003, 0.001
NEIGHBOUR_CHANCE, NEIGHBOUR_WEIGHT = 0.001, 5.0
#: Documents that must share a running header before it is known where it stands once.
HEADER_SUPPORT = 3
#: Rows of a table up to which it is sent to all tasks; a longer one is joined by shuffle.
SENT_ROWS = 200_000
MOST_EDITS = 2
_FLUSH = 400_000
#: Words whose neighbours are counted at once, and different tokens that a task remembers.
_AT_ONCE, _REMEMBERED = 1_000_000, 1_000_000
#: Lines of text that a page has at least.
PAGE_LINES = 8

# What a scanned sign is taken for (true signs, read signs).
MISREAD = (
    ("m", "rn"), ("m", "nn"), ("n", "ri"), ("n", "u"), ("u", "n"), ("h", "li"), ("h", "b"), ("b", "lo"), ("b", "6"), ("b", "h"), ("d", "cl"), ("đ", "cl"), ("đ", "d"), ("đ", "đ'"),
    ("c", "("), ("c", "e"), ("e", "c"), ("t", "l"), ("t", "f"), ("l", "1"), ("l", "i"), ("l", "|"), ("l", "t"), ("i", "1"), ("i", "!"), ("i", "l"), ("i", "|"), ("i", "ỉ"), ("g", "9"), ("g", "q"), ("o", "0"), ("s", "5"), ("z", "2"), ("w", "vv"),
    ("ư", "ir"), ("ơ", "o'"), ("ư", "u'"), ("q", "g"), ("r", "i"), ("a", "o"), ("y", "v"),
)

_HYPHENS = "-‐‑¬­"
_DIGIT = "0-9lIOZ|!oôSB"
_PAGE = re.compile(rf"^(?:\[\s*([{_DIGIT}]{{1,4}})\s*\]|[-–—]\s*([{_DIGIT}]{{1,4}})\s*[-–—]|(?:Trang|Tr\s?[.,])\s*([{_DIGIT}]{{1,4}})(?:\s*/\s*[{_DIGIT}]{{1,4}})?|([{_DIGIT}]{{1,4}}))$")
_AMOUNT = re.compile(r"^\d{1,3}(?:[.,]\d{3})+$")
_EDGE_PAGE = re.compile(rf"^(?:(.*\S)\s{{2,}}([{_DIGIT}]{{1,4}})|([{_DIGIT}]{{1,4}})\s{{2,}}(\S.*))$")
_BEGIN = re.compile(r"^(?:Điều\s+\d+|Chương\s+[IVXLC\d]+|Mục\s+\d+|Phần\s+[IVXLC\d]+|Phụ lục\b|Mẫu số\b|Căn cứ\b|Số:|Văn bản này\b|Nơi nhận|Ghi chú\s*:|\d{1,3}\.\s|\d{1,2}\)\s|[a-zđ]\)\s|[-+•*]\s)")
_TO_DIGIT = str.maketrans("lIOZ|!oôSB", "1102110058")


def _number(sign: str) -> int | None:
    try:
        return int(sign.translate(_TO_DIGIT))
    except ValueError:
        return None


def line_mask(line: str) -> str:
    """A line with its page number taken off and digits made alike."""
    m = _EDGE_PAGE.match(line)
    body = (m[1] or m[4]) if m else line
    return re.sub(r"\d+", "0", " ".join(body.split())).lower()


def _pairs_of(text: str) -> frozenset[str]:
    return frozenset(map("".join, zip(text, text[1:])))


def _most_signs(mask: str) -> int:
    """Signs in which a line may differ from a header."""
    return max(2, len(mask) // 5)


@lru_cache(maxsize=100_000)
def _alike(a: str, b: str) -> bool:
    """True if lines differ in at most a fifth of their signs."""
    if a == b:
        return True
    most = _most_signs(b)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


_HAS_DIGIT = re.compile(r"\d")


def _may_head(line: str) -> bool:
    if len(line) < 5 or line[-1] in ".;:,":
        return False
    digit = _HAS_DIGIT.search(line)
    if not digit and not line[1].isupper() and not line[2].isupper():
        return False
    if _BEGIN.match(line) or _PAGE.match(line):
        return False
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 5 and (digit is not None or sum(map(str.isupper, letters)) > 0.7 * len(letters))


def _masks(lines: list[str]) -> dict[str, list[int]]:
    """Masks of the lines that may be headers, with their positions.

    Only lines with digits or in capitals that are no page number and don't end
    like a sentence may be headers.
    """
    masks: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        if _may_head(line):
            masks.setdefault(line_mask(line), []).append(i)
    return masks


def headers_within(lines: list[str], known: frozenset[str] = frozenset()) -> dict[int, str]:
    """Positions of running headers among non-empty lines, with the mask of each.

    A header comes back at least a page later; known ones may stand once.
    """
    return _headers_of(_masks(lines), known)


def _headers_of(masks: dict[str, list[int]], known: frozenset[str]) -> dict[int, str]:
    # copies of a header differ by misreadings: lines are held against masks that come back and against known ones
    seeds = {m: list(at) for m, at in masks.items() if len(at) > 1 and min(b - a for a, b in zip(at, at[1:])) >= PAGE_LINES}
    for k in known:
        seeds.setdefault(k, list(masks.get(k, ())))
    signs = {m: _pairs_of(m) for m in seeds}
    for mask, at in masks.items():
        if mask in seeds:
            continue
        for m in seeds:
            if abs(len(mask) - len(m)) <= _most_signs(m) and 2 * len(_pairs_of(mask) & signs[m]) >= len(signs[m]) and _alike(mask, m):
                seeds[m] += at
                break
    return {i: m for m, at in seeds.items() for i in at}


def pages_within(lines: list[str], heads: dict[int, str]) -> set[int]:
    """Positions of lines that are page numbers.

    Numbers in brackets, dashes or after a word for page are taken as such.
    Bare numbers must go up by one from page to page, at least PAGE_LINES
    lines apart, or stand next to a header or (alone or above 9) at an end of
    the text; numbered cells of a table follow each other more closely.
    """
    sure, bare = set(), []
    for i, line in enumerate(lines):
        if len(line) <= 16 and (m := _PAGE.match(line)):
            if m[4] is None:
                if re.search(r"\d", line) or _number(m[1] or m[2] or m[3] or "") is not None:
                    sure.add(i)
            elif re.search(r"\d|^[lI|!]{1,3}\d*$", line) and (n := _number(m[4])) is not None:
                bare.append((i, n))
    cells, run = set(), []
    for i, n in bare:
        if run and n == run[-1][1] + 1 and i - run[-1][0] <= PAGE_LINES:
            run.append((i, n))
            cells |= {x for x, _ in run}
        elif n == 1:
            run = [(i, n)]
            if any(_AMOUNT.match(x) for x in lines[i + 1 : i + 4]):
                cells.add(i)
    # numbers that count up within a page are cells wherever they start; only the last page may be short
    cells |= {x for a, (i, n) in enumerate(bare) for j, k in bare[a + 1 : a + 4] if k == n + 1 and j - i < PAGE_LINES and j != len(lines) - 1 for x in (i, j)}
    free = [(i, n) for i, n in bare if i not in cells]
    chained = {x for (i, n), (j, k) in zip(free, free[1:]) if k == n + 1 and (j - i >= PAGE_LINES or j == len(lines) - 1) for x in (i, j)}
    at_end = lambda i, n: i in (0, len(lines) - 1) and (n > 9 or len(bare) == 1)
    edges = {i for i, n in free if at_end(i, n) or i - 1 in heads or i + 1 in heads}
    return sure | chained | edges


class Tidy:
    """One text without furniture: its paragraphs, and what kinds of layout noise it had."""

    def __init__(self, text: str, known: frozenset[str] = frozenset()):
        lines = _lines(text)
        self.heads = headers_within(lines, known)
        pages = pages_within(lines, self.heads) - set(self.heads)
        self.noise = set()
        if self.heads:
            self.noise.add("header")
        if pages or any(_EDGE_PAGE.match(lines[i]) for i in self.heads):
            self.noise.add("page_no")
        kept = [x for i, x in enumerate(lines) if i not in self.heads and i not in pages]
        self.paragraphs = self._reflowed(kept)

    def _reflowed(self, lines: list[str]) -> list[str]:
        if not lines:
            return []
        lengths = sorted(len(x) for x in lines)
        width = lengths[min(len(lengths) - 1, int(0.9 * len(lengths)))]
        wrapped = sum(1 for x in lengths if x >= 0.8 * width) > 0.3 * len(lengths)
        out = [lines[0]]
        before = lines[0]
        for line in lines[1:]:
            last = out[-1]
            if len(last) > 1 and last[-1] in _HYPHENS and last[-2].isalpha() and line[0].islower():
                out[-1] = last[:-1] + line
                self.noise.add("hyphen")
            elif self._goes_on(before, line, width, wrapped):
                out[-1] = f"{last} {line}"
            else:
                out.append(line)
            before = line
        return out

    @staticmethod
    def _goes_on(before: str, line: str, width: int, wrapped: bool) -> bool:
        if _BEGIN.match(line) or before.isupper() != line.isupper():
            return False
        first = line.split(" ", 1)[0]
        if before[-1] in ".;:!?" and not line[0].islower() and len(before) + 1 + len(first) <= width:
            return False
        if not wrapped:
            return line[0].islower() and before[-1] not in ".;:!?"
        full = len(before) + 1 + len(first) > width - 2
        return full or (line[0].islower() and before[-1] not in ".;:!?")


# ---------------------------------------------------------------- words

_EDGES = "\"“”‘’«»[]{}<>.,;:?…"


def core(token: str) -> tuple[str, str, str]:
    """A token as (signs before, word, signs after); brackets stay with the word unless they pair up or stand alone."""
    a = 0
    while a < len(token) and token[a] in _EDGES:
        a += 1
    b = len(token)
    while b > a and token[b - 1] in _EDGES:
        b -= 1
    word = token[a:b]
    if word.endswith(")") and "(" not in word:
        b -= 1
    elif word.startswith("(") and ")" in word:
        a, b = a + 1, b - word.endswith(")")
    return token[:a], token[a:b], token[b:]


def word_of(token: str) -> str:
    return unicodedata.normalize("NFC", core(token)[1]).lower()


_WORDY = re.compile(r"[^\W\d_]")
_PLAIN = re.compile(r"^[^\W\d_]+$")


# ---------------------------------------------------------------- candidates


def trie_of(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def within(trie: dict, word: str, most: int) -> list[str]:
    """All words of the trie within ``most`` edits of ``word``.

    The Levenshtein automaton of the word is simulated with one bit set of
    positions per number of edits and walks the trie; branches on which no
    state is left are not entered.
    """
    n = len(word)
    masks: dict[str, int] = {}
    for i, ch in enumerate(word):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << (n + 1)) - 1
    start = []
    bits = 1
    for e in range(most + 1):
        start.append(bits & full)
        bits |= bits << 1
    out = []
    stack = [(trie, tuple(start))]
    accept = 1 << n
    while stack:
        node, states = stack.pop()
        for ch, child in node.items():
            if ch == "":
                if states[most] & accept:
                    out.append(child)
                continue
            hit = masks.get(ch, 0)
            now = []
            below_old = below_new = 0
            for e in range(most + 1):
                old = states[e]
                new = (old & hit) << 1
                if e:
                    new |= below_old | (below_old << 1) | (below_new << 1)
                now.append(new & full)
                below_old, below_new = old, now[e]
            if now[most]:
                stack.append((child, tuple(now)))
    return out


def _base(ch: str) -> str:
    return "d" if ch == "đ" else unicodedata.normalize("NFD", ch)[0]


def explained(read: str, true: str, most: int = 2) -> tuple[int, int] | None:
    """(misreadings, changed accents) that turn ``true`` into ``read``, fewest first; None if more than ``most`` or none do."""
    best: list[tuple[int, int] | None] = [None]

    def walk(i: int, j: int, signs: int, accents: int) -> None:
        if signs + accents > most or (best[0] is not None and signs + accents >= sum(best[0])):
            return
        if i == len(true) and j == len(read):
            best[0] = (signs, accents)
            return
        if i < len(true) and j < len(read) and true[i] == read[j]:
            walk(i + 1, j + 1, signs, accents)
        for t, r in MISREAD:
            if true.startswith(t, i) and read.startswith(r, j):
                walk(i + len(t), j + len(r), signs + 1, accents)
        if i < len(true) and j < len(read) and true[i] != read[j] and _base(true[i]) == _base(read[j]) and read[j].isalpha():
            walk(i + 1, j + 1, signs, accents + 1)
            # an accent that is read as a sign of its own: the letter loses it, a dot or stroke follows
            if j + 1 < len(read) and read[j + 1] in ".'`,":
                walk(i + 1, j + 2, signs + 1, accents)
        if j and j < len(read) and read[j] in "'.`" and i < len(true):
            walk(i, j + 1, signs + 1, accents)

    walk(0, 0, 0, 0)
    return best[0] if best[0] and sum(best[0]) else None


# ---------------------------------------------------------------- over the collection


class _Words(dict):
    """The word of each token met, remembered per task."""

    def __missing__(self, token: str) -> str:
        if len(self) > _REMEMBERED:
            self.clear()
        self[token] = out = word_of(token)
        return out


class _Numbers(dict):
    """A number for the word of each token met; 0 is the end of a text."""

    def __init__(self):
        self.words, self.number = [""], {}

    def __missing__(self, token: str) -> int:
        word = word_of(token)
        out = self.number.get(word)
        if out is None:
            out = self.number[word] = len(self.words)
            self.words.append(word)
        self[token] = out
        return out


class _Neighbours:
    """Counts of neighbouring words, the last word of a text beside ""; a pair is one number, and pairs are sorted and counted many at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.waiting, self.size = _Numbers(), [], 0
        self.pairs = self.counts = np.zeros(0, np.int64)

    def add(self, tokens: list[str]) -> None:
        of = np.zeros(len(tokens) + 1, np.int64)
        of[:-1] = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        self.waiting.append((of[:-1] << 32) | of[1:])
        self.size += len(tokens)
        if self.size > _AT_ONCE:
            self.count()

    def count(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        self.pairs, at = np.unique(np.concatenate([self.pairs, new]), return_inverse=True)
        counts = np.zeros(len(self.pairs), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, n]))
        self.counts = counts

    def full(self) -> bool:
        return len(self.pairs) > _FLUSH or len(self.numbers) > _REMEMBERED

    def rows(self) -> Iterator[pd.DataFrame]:
        self.count()
        words = np.array(self.numbers.words, dtype=object)
        for i in range(0, len(self.pairs), _FLUSH):
            pairs = self.pairs[i : i + _FLUSH]
            yield pd.DataFrame({"kind": "pair", "a": words[pairs >> 32], "b": words[pairs & 0xFFFFFFFF], "n": self.counts[i : i + _FLUSH], "h": 0})
        self.clear()


_BROKEN = re.compile(r"[-‐‑¬\xad](?<=[^\W\d_].)[ \t]*\n\s*(?=[^\W\d_A-ZĐÀ-Ỹ])")


def _lines(text: str) -> list[str]:
    return [x for x in (x.strip(" \t\r\v") for x in text.replace("\f", "\n").split("\n")) if x]


_COUNTED = "kind string, a string, b string, n long, h long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of different texts: neighbouring words (the last word of a text stands before "") and running headers with their numbers, added up per task, and lines that may be headers which stand once."""
    pairs, heads, alone = _Neighbours(), Counter(), []

    def out() -> Iterator[pd.DataFrame]:
        yield from pairs.rows()
        yield pd.DataFrame([("head", a, "", n, 0) for a, n in heads.items()] + [("line", a, "", 1, h) for h, a in alone], columns=["kind", "a", "b", "n", "h"])
        for x in (heads, alone):
            x.clear()

    for batch in batches:
        for h, text in zip(batch["_h"], batch["_text"]):
            pairs.add(_BROKEN.sub("", text).split())
            masks = _masks(_lines(text))
            own = _headers_of(masks, frozenset())
            heads.update(set(own.values()))
            alone += [(h, m) for m, at in masks.items() if any(i not in own for i in at)]
            if pairs.full():
                yield from out()
    yield from out()


def _asked(word: str) -> bool:
    """True for words that may be misread ones.

    A word of the vocabulary has letters only, so each other sign takes an
    edit; no misreading makes a slash or a hyphen.  One sign alone tells nothing.
    """
    if len(word) < 2 or "/" in word or "-" in word:
        return False
    letters = sum(map(str.isalpha, word))
    return letters >= 1 and len(word) - letters <= MOST_EDITS


def _routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with the first letters (without accents) and lengths that words they were read from may have."""
    for b in batches:
        out = []
        for word, n in zip(b["word"], b["n"]):
            if _asked(word):
                edits = MOST_EDITS if len(word) > 2 else 1
                firsts = {_base(word[0])} | {_base(t[0]) for t, r in MISREAD if word.startswith(r)}
                out += [(f, size, word, n) for f in firsts for size in range(max(1, len(word) - edits), len(word) + edits + 1)]
        yield pd.DataFrame(out, columns=["first", "size", "word", "n"])


def _first_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"first": [_base(w[0]) for w in b["word"]], "size": b["word"].str.len(), "word": b["word"], "n": b["n"]})


_CANDIDATE = ["word", "candidate", "n", "n_candidate", "signs", "accents"]


def _looked_up(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Explained candidates of the words of one lot in one trie."""
    count = dict(zip(held["word"], held["n"]))
    out = []
    if count and len(asked):
        trie, most = trie_of(list(count)), max(count.values())
        for word, n in zip(asked["word"], asked["n"]):
            if most < DOMINANCE * n:
                continue
            for c in within(trie, word, MOST_EDITS if len(word) > 2 else 1):
                if count[c] >= DOMINANCE * n and (how := explained(word, c)):
                    out.append((word, c, n, count[c], *how))
    return pd.DataFrame(out, columns=_CANDIDATE)


def _candidates(words: DataFrame) -> DataFrame:
    """``word, candidate, n, n_candidate, signs, accents``: the much more frequent words each word may have been read from."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    letters_only = words.where((F.col("n") >= DOMINANCE) & F.col("word").rlike(r"^\p{L}+$"))
    held = letters_only.mapInPandas(_first_letters, "first string, size int, word string, n long")
    asked = cut(words.where(F.length("word") > 1).mapInPandas(_routed, "first string, size int, word string, n long"))
    lots = asked.groupBy("first", "size").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("_lots"))  # a row for each letter and length
    asked = asked.join(F.broadcast(lots), ["first", "size"]).withColumn("_lot", F.pmod(F.xxhash64("word"), F.col("_lots")).cast("int"))
    held = held.join(F.broadcast(lots), ["first", "size"]).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))
    at = ["first", "size", "_lot"]
    # a number of partitions is given, so that little data with much work isn't put into one task
    asked, held = (x.select(*at, "word", "n").repartition(parts, *at) for x in (asked, held))
    return asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(_looked_up, "word string, candidate string, n long, n_candidate long, signs int, accents int")


def _sent(rows: DataFrame) -> DataFrame:
    """A table to be sent to all tasks if it is short, else to be joined as Spark sees fit."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _headers_alike(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``h, mask``: the lines of texts that are known headers or differ from one by few signs.

    A line within a fifth of a header's signs is about as long as it and holds
    one of the header's rarest three-sign sequences: of n sequences and d edits
    any 3 d + 1 will do.
    """
    known = heads.select(F.col("a").alias("known"))
    edits = F.greatest(F.lit(2), F.floor(F.length("known") / 5)).cast("int")
    sizes = known.select(F.explode(F.sequence(F.length("known") - edits, F.length("known") + edits)).alias("size")).distinct()
    masks = cut(lines.select("mask").distinct().join(_sent(sizes), F.length("mask") == F.col("size"), "left_semi"))
    same = cut(masks.join(_sent(known), F.col("mask") == F.col("known"), "left_semi"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    signs = cut(known.where("length(known) >= 3").select("known", F.explode(grams("known")).alias("g")))
    # sequences that no header holds are left out before anything is moved
    held = masks.join(_sent(same), "mask", "left_anti").where("length(mask) >= 3").select("mask", F.explode(grams("mask")).alias("g")).join(_sent(signs.select("g").distinct()), "g", "left_semi")
    counted = signs.join(held.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g", "left")
    rank = F.row_number().over(Window.partitionBy("known").orderBy(F.coalesce("c", F.lit(0)), "g"))  # the sequences of one header
    rare = counted.withColumn("_rank", rank).where(F.col("_rank") <= 3 * edits + 1).where("c is not null")
    size = F.abs(F.length("mask") - F.length("known")) <= edits
    met = rare.join(held, "g").where(size).select("mask", "known").distinct()

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2 * len(_pairs_of(x) & _pairs_of(y)) >= len(_pairs_of(y)) and _alike(x, y) for x, y in zip(a, b)], dtype=bool)

    near = met.where(alike("mask", "known")).select("mask")
    return lines.join(_sent(cut(same.unionByName(near).distinct())), "mask", "left_semi")


def _doubtful(passed: frozenset[str]):
    """Per text: kinds of layout noise, and the places of all words that may be misread, with their neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sound = _Words(), set()  # sound: tokens of words that aren't looked at
        for b in batches:
            out = []
            for key, text, known in zip(b["_key"], b["_text"], b["known"]):
                tidy, places, pos = Tidy(text, frozenset() if known is None else frozenset(known)), [], 0
                for p in tidy.paragraphs:
                    tokens = p.split()
                    if not sound.issuperset(tokens):
                        odd = set(filterfalse(sound.__contains__, tokens))
                        well = {t for t in odd if words[t] in passed or not _asked(words[t])}
                        if len(sound) > _REMEMBERED:
                            sound.clear()
                        sound |= well
                        if odd := odd - well:
                            seq = list(map(words.__getitem__, tokens))
                            for i in [i for i, t in enumerate(tokens) if t in odd]:
                                places.append({"pos": pos + i, "before": seq[i - 1] if i else "", "word": seq[i], "after": seq[i + 1] if i + 1 < len(seq) else ""})
                    pos += len(tokens)
                out.append((key, sorted(tidy.noise), places))
            yield pd.DataFrame(out, columns=["_key", "kinds", "places"])

    return run


def _cased(read: str, word: str) -> str:
    """The word in the case of what was read."""
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    first = next((c for c in read if c.isalnum()), "")
    if first == "I" and word[:1] == "l":
        return word
    return word[:1].upper() + word[1:] if first.isupper() else word


def _mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for key, text, known, fixes in zip(b["_key"], b["_text"], b["known"], b["fixes"]):
            tidy = Tidy(text, frozenset() if known is None else frozenset(known))
            at = {f["pos"]: f["word"] for f in fixes} if fixes is not None else {}
            pos, paragraphs = 0, []
            for p in tidy.paragraphs:
                tokens = p.split()
                for i, t in enumerate(tokens):
                    if pos + i in at:
                        before, read, after = core(t)
                        tokens[i] = before + _cased(read, at[pos + i]) + after
                pos += len(tokens)
                paragraphs.append(" ".join(tokens))
            out.append((key, "\n".join(paragraphs), sorted(tidy.noise | ({"glyph"} if at else set()))))
        yield pd.DataFrame(out, columns=["_key", "repaired", "noise"])


class Scans:
    """Repairs of a collection of scanned texts: what was noisy, and the repaired texts.

    ``texts`` has the columns ``key`` and ``text``; other columns are not read.
    Null texts have no noise and no repaired text, empty ones an empty text.
    Rows with the same key are taken as the same text: their noise is put
    together, and one of their texts is returned.  Null keys are left out.  An
    empty table gives empty results.
    """

    def __init__(self, texts: DataFrame, key: str, text: str):
        self.key = key
        self.rows = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_key is not null and _text is not null")
        self.kind = self.rows.schema["_key"].dataType.simpleString()
        self._prepare()

    def _prepare(self) -> None:
        hashed = self.rows.withColumn("_h", F.xxhash64("_text"))
        # words and headers are counted over different texts, however many rows repeat one
        again = cut(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first")).where("_n > 1").select("_h", "_first"))
        once = hashed.join(_sent(again), "_h", "left").where("_first is null or _key = _first").select("_h", "_text")
        raw = cut(once.mapInPandas(_counted, _COUNTED))
        self.pairs = cut(raw.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n")))
        words = cut(self.pairs.where("a <> ''").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
        self.total = words.agg(F.sum("n")).first()[0] or 0
        heads = cut(raw.where("kind = 'head'").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HEADER_SUPPORT).select("a"))
        lines = raw.where("kind = 'line'").select("h", F.col("a").alias("mask"))  # each once for each different text
        self.heads = _sent(cut(_headers_alike(lines, heads).groupBy(F.col("h").alias("_h")).agg(F.collect_set("mask").alias("known"))))  # the lines of one text
        found = cut(_candidates(words))
        # what is surely a misreading itself is no candidate
        misread = found.where(F.col("n_candidate") >= SURE * F.col("n")).select(F.col("word").alias("candidate")).distinct()
        self.candidates = cut(found.join(misread, "candidate", "left_anti"))
        frequent = words.join(self.candidates.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(PASSED_WORDS)
        passed = frozenset(r[0] for r in frequent.select("word").collect())  # at most PASSED_WORDS
        self.texts = hashed.join(self.heads, "_h", "left").select("_key", "_text", "known")
        seen = self.texts.mapInPandas(_doubtful(passed), f"_key {self.kind}, kinds array<string>, places array<struct<pos:int,before:string,word:string,after:string>>")
        self.seen = cut(seen)

    def fixes(self) -> DataFrame:
        """``_key, pos, word``: the words that are better read as another one, each at its place among the words of the text.

        A word that is not rare beside what it may be is changed only in a text
        that surely has misread words; alone, it is an unusual word in its place.
        """
        fixed = self._fixed(self._options())
        misread = fixed.where("_sure").select("_key").distinct()
        return fixed.join(misread, "_key", "left_semi").select("_key", "pos", F.col("b.candidate").alias("word"))

    def _options(self) -> DataFrame:
        """``word, _sure`` with each candidate of the word, and the word itself."""
        keep = F.struct(F.col("word").alias("candidate"), F.col("n").alias("n_candidate"), F.lit(0).alias("signs"), F.lit(0).alias("accents"))
        options = self.candidates.groupBy("word").agg(F.first("n").alias("n"), F.max("n_candidate").alias("_most"), F.collect_list(F.struct("candidate", "n_candidate", "signs", "accents")).alias("o"))
        return options.select("word", (F.col("_most") >= SURE * F.col("n")).alias("_sure"), F.explode(F.concat("o", F.array(keep))).alias("o")).select("word", "_sure", "o.*")

    def _fixed(self, options: DataFrame) -> DataFrame:
        """``_key, pos, word, b, _sure``: the places whose word is better read as another one of its options."""
        places = self.seen.select("_key", F.explode("places").alias("p")).select("_key", "p.*").distinct()
        asked = places.join(options, "word")
        left = self.pairs.select(F.col("a").alias("before"), F.col("b").alias("candidate"), F.col("n").alias("n_left"))
        right = self.pairs.select(F.col("a").alias("candidate"), F.col("b").alias("after"), F.col("n").alias("n_right"))
        met = asked.join(left, ["before", "candidate"], "left").join(right, ["candidate", "after"], "left")
        # the place itself is one of the counts of the word that stands there
        self_count = F.when(F.col("candidate") == F.col("word"), 1).otherwise(0)
        n = F.greatest(F.col("n_candidate") - self_count, F.lit(0))
        beside = lambda c: (F.greatest(F.coalesce(c, F.lit(0)) - self_count, F.lit(0)) + NEIGHBOUR_WEIGHT * NEIGHBOUR_CHANCE) / (n + NEIGHBOUR_WEIGHT)
        chance = F.log((n + 0.5) / F.lit(float(max(self.total, 1)))) + F.log(beside(F.col("n_left"))) + F.log(beside(F.col("n_right")))
        chance = chance + F.col("signs") * F.log(F.lit(SIGN_CHANCE)) + F.col("accents") * F.log(F.lit(ACCENT_CHANCE))
        best = met.withColumn("_s", chance).groupBy("_key", "pos", "word").agg(F.max(F.struct("_s", "candidate")).alias("b"), F.max("_sure").alias("_sure"))
        return best.where("b.candidate <> word")

    def noise(self) -> DataFrame:
        """``<key>, noise``: one row for each kind of noise in a text: hyphen, glyph, header or page_no."""
        layout = self.seen.select("_key", F.explode("kinds").alias("noise"))
        # a text has fixes if a sure one is among them, so the places of other words aren't weighed
        glyph = self._fixed(self._options().where("_sure")).select("_key", F.lit("glyph").alias("noise"))
        return layout.unionByName(glyph).distinct().withColumnRenamed("_key", self.key)

    def repaired(self) -> DataFrame:
        """``<key>, repaired, noise``: texts as one paragraph per line, and the kinds of noise they had."""
        fixes = self.fixes().groupBy("_key").agg(F.collect_list(F.struct("pos", "word")).alias("fixes"))  # of one text each
        rows = self.texts.groupBy("_key").agg(F.max(F.struct("_text", "known")).alias("r")).select("_key", "r.*").join(fixes, "_key", "left")
        return rows.mapInPandas(_mended, f"_key {self.kind}, repaired string, noise array<string>").withColumnRenamed("_key", self.key)
