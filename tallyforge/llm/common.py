"""What the corpus operators share: table access, staged tables and a bounded word table for Python tasks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import bucketed, fresh_path, local_path, released, removed, shared_dir, staged  # noqa: F401  for the operators

#: Words of all operators: maximal runs of anything but ASCII white space. bytes.split() splits the same way.
WORD = r"[^\x20\x09-\x0D]+"


#: Common words of the corpus languages, fixed.
COMMON_WORDS = frozenset(
    w.encode()
    for w in (
        "the and of to a in is that for it on with as was at by be this from are or an "
        "le la les de des du et un une en que qui est dans pour par sur pas au avec "
        "der die das und ist den von zu mit nicht ein eine auf im sich dem auch es "
        "el los las y del se por con para su al lo como"
    ).split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path, so it may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with more than 1 / (HOT * partitions) of all rows are hot; there are at most HOT * partitions of them, whatever the data.
HOT = 16


def lookup(rows: DataFrame, found: DataFrame, key: str, counts: DataFrame, how: str = "inner", total: int | None = None, whole: bool = False) -> DataFrame:
    """rows joined with found, which has one row for each key, where few keys may hold many rows.

    counts: key and count, the number of rows of each key, staged; total may give at least the sum of them. Rows of hot keys stay where they are and get a broadcast of
    at most HOT * partitions rows; all others are joined by key. how is inner or left. If no key is hot this is a plain join, and if all are
    and whole says that found (inner) has no others, a broadcast of found: each exchange that is left out saves the driver a thread and a part of a plan.
    """
    most = HOT * partitions(rows.sparkSession)
    total = counts.agg(F.sum("count")).first()[0] or 0 if total is None else total
    often = F.col("count") > total / most
    hot = counts.where(often).select(key)
    if hot.isEmpty():
        return rows.join(found, key, how)
    if whole and how == "inner" and counts.where(~often).isEmpty():
        return rows.join(F.broadcast(found), key)
    known = found.join(F.broadcast(hot), key, "left_semi")
    near = rows.join(F.broadcast(known if how == "inner" else hot.join(F.broadcast(known), key, "left")), key)
    far = rows.join(F.broadcast(hot), key, "left_anti").join(found, key, how)
    return near.select(*far.columns).unionByName(far)


def unit_hash(seed: str, *cols: Column) -> Column:
    """A 52-bit uniform number of the columns, the same in any SQL engine (md5)."""
    parts = [F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


#: Rows that go to Python at once: texts may be long, and both sides hold them.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH_ROWS for the tasks in Python of what is run (not only planned) inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of text that are Python objects at once.
BATCH_BYTES = 1 << 21


def in_parts(column: pa.Array) -> Iterator[tuple[int, list]]:
    """(first index, texts) of runs with about BATCH_BYTES, which alone become Python objects; null is empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, empty = 0, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    while low < len(column):
        before = int(size[low - 1]) if low else 0
        high = min(len(column), int(np.searchsorted(size, before + BATCH_BYTES)) + 1)
        yield low, [t or empty for t in column.slice(low, high - low).to_pylist()]
        low = high


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))  # a random number for each byte
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WINDOW_BYTES = 1 << 20


@lru_cache(2)
def _powers(step: int, n: int) -> np.ndarray:
    """step ** i modulo 2 ** 64, for i below n."""
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    A word's hash is a polynomial over random numbers for its bytes, so all words of a window of WINDOW_BYTES (or of one longer word)
    are hashed by a running sum over its bytes.
    """
    if not texts:
        return []
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        first = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, first + WINDOW_BYTES, "right")))
        span = int(ends[high - 1] - first)
        size = max(WINDOW_BYTES, 1 << (span - 1).bit_length())
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(_BYTE[raw[first : first + span]] * _powers(int(_STEP), size)[:span], out=total[1:])
        s, e = starts[low:high] - first, ends[low:high] - first
        out[low:high] = mix64((total[e] - total[s]) * _powers(int(_BACK), size)[s] + (e - s).astype(np.uint64))
        low = high
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, bounds)
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


class Grown:
    """A numpy copy of a growing list; each item is copied about once."""

    def __init__(self, dtype, width: int | None = None):
        self.width, self.dtype = width, dtype
        self.reset()

    def reset(self) -> None:
        self.n, self.data = 0, np.empty((1024, *([self.width] if self.width else [])), self.dtype)

    def of(self, items: list) -> np.ndarray:
        if len(items) > len(self.data):
            data = np.empty((2 * len(items), *self.data.shape[1:]), self.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        if len(items) > self.n:
            self.data[self.n : len(items)] = items[self.n :]
            self.n = len(items)
        return self.data


class WordTable(dict):
    """Words to rows of growing arrays, filled on first sight; at most ``limit`` words, then it starts anew.

    A task keeps it across batches; its size is bounded, so memory does not follow the vocabulary. Numbers lie in arrays, not as objects.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.hashes, self.extra = array("Q"), self.fresh()

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.added(word)
        return row

    def fresh(self) -> list | array:
        """For subclasses: an empty extra."""
        return []

    def added(self, word: bytes) -> None:
        """For subclasses: called once for each new word."""

    def trim(self) -> None:
        """Call between documents: forget everything once the limit is passed."""
        if len(self) > self.limit:
            self.clear()
            self.hashes, self.extra = array("Q"), self.fresh()

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def word_hashes(self, rows: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of rows."""
        return mix64(np.frombuffer(self.hashes, np.uint64)[rows]) if len(rows) else np.empty(0, np.uint64)
