"""Problem 3: near-duplicate texts by anchor points of a covering code.

Each text becomes a min-wise sketch of its word sequences.  Bits of the sketch
make words of 23 bits, and the binary Golay code is the set of anchors: every
word has one anchor within the covering radius 3, its home, and is copied to
all anchors within radius 3 + 1.  Texts meet at the home of either one, if the
key's sketch values agree too; meetings that the rest of the sketch makes
unlikely are dropped, and all others are compared exactly, word sequence by
word sequence.  Texts with equal words are one class and are compared once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

BINS = 256
TABLES = 30
BITS = 23
#: Sketch values in a key beside its anchor: each cuts the meetings of unlike texts to a tenth or less.
VALUES = 2
RADIUS, SLACK = 3, 1
#: Bits of 128 in which the sketches of texts that meet may differ: at similarity 0.7 about 19 with a deviation of 4, or 7 for the shortest texts.
MOST_APART = 36
#: Ids up to which a list of them is sent to all; a longer one is joined by shuffle.
SENT_IDS = 1_000_000
_CHUNK_BYTES = 8_000_000
_EMPTY = np.uint32(0xFFFFFFFF)


# ---------------------------------------------------------------- word sequences


class _WordHash(dict):
    """64-bit hash of each word met, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII white space, in lower case."""
    return text.lower().encode().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word sequences of one array of word hashes; shorter arrays give none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        total = (total ^ (words[i : i + m] * _ODD[i % len(_ODD)])) * np.uint64(0x9FB21C651E98DF25)
    return _mix(total)


def _hashed(words: list[bytes], known: _WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _least(bins: np.ndarray, row: int | np.ndarray, hashes: np.ndarray) -> None:
    np.minimum.at(bins, row * BINS + (hashes >> np.uint64(56)).astype(np.int64), ((hashes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))


# ---------------------------------------------------------------- sketches


_BODY = "_id {kind}, n_words long, same long, ends array<long>, least binary"


def _sketch_bodies(n: int, least_words: int):
    """Per text: number of words, hash of all words, its first n-1 words, and the least hash of each bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for b in batches:
            ids, texts, out, at = b["_id"].tolist(), b["_text"].tolist(), [], 0
            while at < len(ids):
                parts, owners, size, begin = [], [], 0, at
                kept = []
                while at < len(ids) and (size < _CHUNK_BYTES or at == begin):
                    words = words_of(texts[at])
                    if len(words) >= least_words:
                        h = _hashed(words, known)
                        s = sequence_hashes(h, n)
                        parts.append(s)
                        owners.append(np.full(len(s), len(kept), dtype=np.int64))
                        kept.append((ids[at], len(h), h))
                    size += len(texts[at])
                    at += 1
                if not kept:
                    continue
                bins = np.full(len(kept) * BINS, _EMPTY)
                _least(bins, np.concatenate(owners), np.concatenate(parts))
                for row, (key, count, h) in enumerate(kept):
                    place = np.arange(1, len(h) + 1, dtype=np.uint64) * _ODD[1]
                    same = np.bitwise_xor.reduce(_mix(h + place)) if len(h) else np.uint64(0)
                    out.append((key, count, int(same.astype(np.int64)), h[: n - 1].astype(np.int64), bins[row * BINS : (row + 1) * BINS].tobytes()))
            yield pd.DataFrame(out, columns=["_id", "n_words", "same", "ends", "least"])

    return run


def _densified(bins: np.ndarray) -> np.ndarray:
    """Empty bins take the value of another one, tried in an order that is the same for every text."""
    bins = bins.copy()
    filled = bins != _EMPTY
    if filled.all() or not filled.any():
        return bins
    full = bins.copy()
    open_ = np.flatnonzero(~filled)
    step = 0
    while len(open_):
        step += 1
        pick = (_mix(open_.astype(np.uint64) * _ODD[2] + np.array([step], dtype=np.uint64) * _ODD[3]) % np.uint64(BINS)).astype(np.int64)
        good = filled[pick]
        bins[open_[good]] = full[pick[good]]
        open_ = open_[~good]
    return bins


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error to the home anchor, and (as slices of one array) all errors within RADIUS + SLACK."""
    generator, patterns = 0b101011100011, []
    for weight in range(RADIUS + SLACK + 1):
        patterns += [sum(1 << i for i in c) for c in itertools.combinations(range(BITS), weight)]
    errors = np.array(patterns, dtype=np.int64)
    at = syndromes(errors, generator)
    order = np.argsort(at, kind="stable")  # by weight within a syndrome
    starts = np.searchsorted(at[order], np.arange(2049))
    return errors[order[starts[:-1]]], errors[order], starts[:-1], np.diff(starts)


def syndromes(words: np.ndarray, generator: int = 0b101011100011) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial of the Golay code."""
    rest = words.copy()
    for i in range(BITS - 1, 10, -1):
        rest = np.where((rest >> i) & 1, rest ^ (generator << (i - 11)), rest)
    return rest


def anchor_rows(bins: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sketches (rows of ``bins``): keys at their homes, keys at all anchors in reach with the row of each, and 128 bits to compare by.

    A key is the table, the anchor and 16 bits of each of VALUES more sketch values.
    """
    home_error, errors, starts, counts = tables or golay_tables()
    homes, reach, owners = [], [], []
    for t in range(TABLES):
        use = t * (BITS + VALUES) + np.arange(BITS + VALUES)
        # bins serve more than one table, each time with another bit
        bit = (bins[:, use[:BITS] % BINS] >> (use[:BITS] // BINS).astype(np.uint32)) & np.uint32(1)
        word = (bit.astype(np.int64) << np.arange(BITS)).sum(axis=1)
        value = np.zeros(len(bins), dtype=np.int64)
        for b in use[BITS:] % BINS:
            value = (value << 16) | ((bins[:, b] >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        s = syndromes(word)
        homes.append((t << 55) | ((word ^ home_error[s]) << 32) | value)
        n = counts[s]
        row = np.repeat(np.arange(len(bins)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        reach.append((t << 55) | ((word[row] ^ errors[starts[s][row] + place]) << 32) | value[row])
        owners.append(row)
    apart = ((bins[:, -128:] >> np.uint32(4)) & np.uint32(1)).astype(np.uint64).reshape(-1, 2, 64)
    signature = (apart << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(np.int64)
    return np.stack(homes, axis=1), np.concatenate(reach), np.concatenate(owners), signature


def _anchored(n: int, at_home: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, tables = _WordHash(), golay_tables()
        for b in batches:
            for at in range(0, len(b), 500):
                lot = b.iloc[at : at + 500]
                bins = np.frombuffer(b"".join(lot["least"]), dtype=np.uint32).reshape(-1, BINS).copy()
                for i, (head, ends) in enumerate(zip(lot["_head"], lot["ends"])):
                    joint = np.concatenate([_hashed(words_of(head or ""), known), np.asarray(ends, dtype=np.int64).astype(np.uint64)])
                    _least(bins[i], 0, sequence_hashes(joint, n))
                    bins[i] = _densified(bins[i])
                homes, reach, owners, signature = anchor_rows(bins, tables)
                row = np.repeat(np.arange(len(bins)), TABLES) if at_home else owners
                yield pd.DataFrame({"key": homes.ravel() if at_home else reach, "_id": lot["_id"].to_numpy()[row], "s0": signature[row, 0], "s1": signature[row, 1]})

    return run


# ---------------------------------------------------------------- operator


class NearCopies:
    """Classes of texts with equal words, and the links between classes.

    ``members``: ``<key>, class_id`` for every document that takes part; the
    class id is the smallest key of its members.  ``links``: ``class_a,
    class_b, similarity`` with class_a < class_b for all pairs of classes whose
    similarity is at least the threshold.
    """

    def __init__(self, members: DataFrame, links: DataFrame, key: str):
        self.members, self.links, self.key = members, links, key

    def pairs(self) -> DataFrame:
        """All pairs of documents, copies written out: ``<key>_a, <key>_b`` with a < b.

        As many rows as there are such pairs; where classes may be large use
        ``members`` and ``links``.
        """
        a = self.members.select(F.col("class_id").alias("class_a"), F.col(self.key).alias("_a"))
        b = self.members.select(F.col("class_id").alias("class_b"), F.col(self.key).alias("_b"))
        across = self.links.join(a, "class_a").join(b, "class_b").select("_a", "_b")
        within = a.join(b, F.col("class_a") == F.col("class_b")).where("_a < _b").select("_a", "_b")
        both = across.unionByName(within)
        return both.select(F.least("_a", "_b").alias(f"{self.key}_a"), F.greatest("_a", "_b").alias(f"{self.key}_b"))

    def groups(self) -> DataFrame:
        """One row per document: ``<key>, class_id, group_id, links``.

        A group is what links connect, named by its smallest key; ``links``
        counts the links of the document's class to other classes.
        """
        groups = connected(self.links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
        ends = self.links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        return (
            self.members.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
            .join(ends, "class_id", "left")
            .select(self.key, "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node it is connected with.

    Alternating large-star and small-star steps; each keeps one row per edge
    and groups only to take a minimum, so a node may have any number of edges.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.where("u <> v").distinct()
        low2 = lower.groupBy("u").agg(F.min("v").alias("m"))
        joined = lower.join(low2, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    pairs = now.groupBy("u").agg(F.min("v").alias("root"))
    roots = now.select(F.col("v").alias("u")).distinct().join(now.select("u").distinct(), "u", "left_anti").select("u", F.col("u").alias("root"))
    return pairs.unionByName(roots).select(F.col("u").alias("node"), "root")


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for b in batches:
            out = [(i, np.unique(sequence_hashes(_hashed(words_of(t), known), n)).astype(np.int64)) for i, t in zip(b["_id"], b["_text"])]
            yield pd.DataFrame(out, columns=["_id", "_set"])

    return run


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to be sent to all if there are at most SENT_IDS, else to be joined as Spark sees fit."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def near_copies(texts: DataFrame, heads: DataFrame | None, *, key: str, text: str, head: str = "title", words: int = 5, similarity: float = 0.8, least_words: int = 0) -> NearCopies:
    """Find the texts whose sets of word sequences are alike.

    The text of a document is its ``head`` (from ``heads``, a table with
    ``key`` and ``head``; nothing where there is none), a line feed and its
    ``text``.  Similarity is the number of different sequences of ``words``
    words in both over the number in either.  Only documents with at least
    ``least_words`` words in ``text`` take part; null texts and null keys
    don't.  Repeated rows of a key count once; where their texts differ, the one
    with the most words (the greatest one in the exact comparison) counts.  Texts too short for one sequence are
    like their exact copies only.  Empty tables give empty results; other
    columns are not read.
    """
    rows = texts.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where("_id is not null and _text is not null")
    kind = rows.schema["_id"].dataType.simpleString()
    bodies = rows.select("_id", "_text").mapInPandas(_sketch_bodies(words, least_words), _BODY.format(kind=kind))
    # repeated rows hold the same text; one sketch of each key is kept
    one = bodies.groupBy("_id").agg(F.max(F.struct("n_words", "same", "ends", "least")).alias("r")).select("_id", "r.*")
    if heads is not None:
        names = heads.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{head}`").alias("_head")).where("_id is not null").groupBy("_id").agg(F.min("_head").alias("_head"))
        one = one.join(names, "_id", "left")
    else:
        one = one.withColumn("_head", F.lit(None).cast("string"))
    head_words = F.xxhash64(F.array_compact(F.transform(F.split(F.lower(F.coalesce("_head", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: F.when(w != "", w))))
    sketched = cut(one.withColumn("_hw", head_words))
    same = ["n_words", "same", "_hw"]
    classes = sketched.groupBy(*same).agg(F.min("_id").alias("class_id"))
    members = sketched.select("_id", *same).join(classes, same).select(F.col("_id").alias(key), "class_id")
    copies = cut(members.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_id")))
    chosen = sketched.select("_id", "ends", "least", "_head").join(_sent(copies), "_id", "left_anti")

    def at_anchors(at_home: bool, a: str) -> DataFrame:
        rows = chosen.mapInPandas(_anchored(words, at_home), f"key long, _id {kind}, s0 long, s1 long")
        return rows.select("key", F.col("_id").alias(f"_{a}"), F.col("s0").alias(f"_{a}0"), F.col("s1").alias(f"_{a}1"))

    apart = sum((F.bit_count(F.col(f"_x{i}").bitwiseXOR(F.col(f"_y{i}"))) for i in (0, 1)), F.lit(0))
    met = at_anchors(True, "x").join(at_anchors(False, "y"), "key").where((F.col("_x") != F.col("_y")) & (apart <= MOST_APART))
    pairs = cut(met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct())
    ids = _sent(cut(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()))
    full = rows.select("_id", "_text").join(ids, "_id", "left_semi").groupBy("_id").agg(F.max("_text").alias("_text"))
    if heads is not None:
        full = full.join(names, "_id", "left").select("_id", F.concat(F.coalesce("_head", F.lit("")), F.lit("\n"), "_text").alias("_text"))
    sets = cut(full.mapInPandas(_sets(words), f"_id {kind}, _set array<long>"))
    compared = (
        pairs.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a")
        .join(sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")), "b")
        .withColumn("_n", F.size(F.array_intersect("_sa", "_sb")))
        .select("a", "b", F.try_divide("_n", F.size("_sa") + F.size("_sb") - F.col("_n")).alias("similarity"))
    )
    links = compared.where(F.col("similarity") >= similarity).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")
    return NearCopies(members, links, key)
