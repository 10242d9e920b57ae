"""Problem 7: filling containers of fixed capacity with texts.

Documents become hashed word vectors, projected to three dimensions; a Hilbert
curve through that space orders them so that neighbours on the curve are alike.
The curve is cut into ranges, and each run of neighbours is packed by best fit.
Sizes are bytes of UTF-8, the tokens of the byte-level tokenizer.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

DIMENSIONS = 3
BITS = 12
BUCKETS = 4096
#: Documents in one range of the curve, and neighbours that are packed together.
RANGE_ROWS = 20_000
RUN_ITEMS = 2048
_CHUNK_CHARS = 2_000_000


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


class _Buckets(dict):
    """Word to bucket of the hashed vector, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little") % BUCKETS
        return out


def _cuts(raw: bytes, capacity: int) -> list[int]:
    """Ends of the parts of an oversized item, none inside a character (unless one alone exceeds the capacity)."""
    ends, at, n = [], 0, len(raw)
    while n - at > capacity:
        end = at + capacity
        while end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        at = end if end > at else at + capacity
        ends.append(at)
    return [*ends, n]


def _items(key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("begin_byte", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            *(T.StructField(f"x{i}", T.FloatType()) for i in range(DIMENSIONS)),
        ]
    )


def _vectors(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, bucket = _projection(), _Buckets()
        for b in batches:
            keys, texts = b["_key"].tolist(), b["_text"].tolist()
            first = 0
            while first < len(keys):
                raws, chars, last = [], 0, first
                while last < len(keys) and (chars < _CHUNK_CHARS or last == first):
                    raws.append((texts[last] or "").encode())
                    chars += len(raws[-1])
                    last += 1
                words, starts = [], []
                for raw in raws:
                    starts.append(len(words))
                    words += raw.split()
                index = np.fromiter(map(bucket.__getitem__, words), dtype=np.int32, count=len(words))
                sums = np.zeros((len(raws) + 1, DIMENSIONS), dtype=np.float64)
                lengths = np.diff([*starts, len(words)])
                some = np.flatnonzero(lengths)
                if len(some):
                    sums[some] = np.add.reduceat(matrix[index].astype(np.float64), np.asarray(starts)[some], axis=0)
                    sums[some] /= lengths[some, None]
                out = []
                for i, raw in enumerate(raws):
                    begin = 0
                    for p, end in enumerate([len(raw)] if len(raw) <= capacity else _cuts(raw, capacity)):
                        out.append((keys[first + i], p, begin, end - begin, *sums[i]))
                        begin = end
                yield pd.DataFrame(out, columns=["_key", "part", "begin_byte", "n_bytes", *(f"x{i}" for i in range(DIMENSIONS))])
                first = last

    return run


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of ``cells``), by Skilling's transposition."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) != 0
            t = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _curve(means: list[float], spreads: list[float]):
    @F.pandas_udf(T.LongType())
    def key(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            z = (np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1) - means) / spreads
            share = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # about the normal distribution's: cells of equal use
            yield pd.Series(hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return key(*(F.col(f"x{i}") for i in range(DIMENSIONS)))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: largest items first, each where it leaves the least space."""
    where = [0] * len(sizes)
    free: list[tuple[int, int]] = []  # (free space, container), sorted
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, box = free.pop(at)
        else:
            room, box, n = capacity, n, n + 1
        where[i] = box
        bisect.insort(free, (room - sizes[i], box))
    return where


PACKED = ["container", "position", "part", "begin_byte", "n_bytes"]


def pack(texts: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Container and position of each item: ``container, position, <key>, part, begin_byte, n_bytes``.

    A text above the capacity, and only such a text, is cut into full parts
    (at the last whole character that fits) and a rest; ``part`` counts them.
    Null and empty texts are items of size 0.  Equal keys are items of their
    own; equal texts fall on one point of the curve and are told apart by
    their keys.  An empty table gives an empty result.  Other columns are not
    read.  A capacity below 1 is refused.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    rows = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType
    items = cut(rows.mapInPandas(_vectors(capacity), _items(kind)))
    stats = items.agg(F.count(F.lit(1)), *(f(f"x{i}") for i in range(DIMENSIONS) for f in (F.avg, F.stddev_pop))).first()
    n, means, spreads = stats[0], [x or 0.0 for x in stats[1::2]], [max(x or 0.0, 1e-9) for x in stats[2::2]]
    # the hash parts ties, so that many equal texts don't make one range
    placed = items.select("_key", "part", "begin_byte", "n_bytes", _curve(means, spreads).alias("_curve"), F.xxhash64(F.col("_key"), F.col("part")).alias("_tie"))
    ranges = placed.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), "_curve", "_tie").sortWithinPartitions("_curve", "_tie", "_key", "part")
    schema = T.StructType([T.StructField("container", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("_key", kind), *_items(kind).fields[1:4]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held) >= RUN_ITEMS:
                out, base = _packed(held.iloc[:RUN_ITEMS], capacity, base)
                yield out
                held = held.iloc[RUN_ITEMS:].reset_index(drop=True)
        if held is not None and len(held):
            yield _packed(held, capacity, base)[0]

    return ranges.drop("_curve", "_tie").mapInPandas(run, schema).withColumnRenamed("_key", key)


def _packed(run: pd.DataFrame, capacity: int, base: int) -> tuple[pd.DataFrame, int]:
    box = np.asarray(best_fit(run["n_bytes"].tolist(), capacity), dtype=np.int64)
    out = run.assign(container=box + base)
    out["position"] = out.groupby("container").cumcount().astype(np.int32)
    return out[["container", "position", "_key", "part", "begin_byte", "n_bytes"]], base + (int(box.max()) + 1 if len(box) else 0)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, bytes, the unused share and the least number of containers these bytes need."""
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("n_bytes").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("bytes"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
