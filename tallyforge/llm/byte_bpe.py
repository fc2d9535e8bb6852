"""Byte-level BPE by rank files, in length-bucketed padded numpy matrices.

Texts are cut by a pattern; each distinct piece that is no token itself becomes a row of token ids (at first its bytes) in
the matrix of its length bucket. Each round looks at the rank that every adjacent pair would merge to, found by a hashed
pair table, merges every row's leftmost pair of least rank and compacts the row by one column, until no pair has a rank.
Pieces of a task are remembered in a table of bounded size, so frequent ones are encoded once; when the task ends they are
forgotten, as its worker lives on and does other work. A piece over LONG bytes is
a row by itself, and a round of it merges all places of the least rank that merging one by one would take in a row, so
its rounds follow the vocabulary and not its length.

Defined cases: a null text counts as empty and has no ids; special tokens are ordinary text; very long pieces have
the same ids as in one-by-one merging; repeated rows are encoded alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, table

NONE = np.int32(2**31 - 1)
FRESH_CHARS = 1 << 21
ROWS = 1 << 14
LONG = 256


class PairTable:
    """(left id, right id) to the id of the merged bytes: open addressing with linear probes, looked up in whole arrays."""

    def __init__(self, tokens: list[bytes], ids: dict[bytes, int]):
        keys, values = [], []
        for merged, token in enumerate(tokens):
            for i in range(1, len(token)):
                a, b = ids.get(token[:i]), ids.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(merged)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, value = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]  # one key for each free slot
            self.keys[at[won]], self.values[at[won]] = left[won], value[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, value, at = left[rest], value[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is none; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        out[(left < 0) | (right < 0)] = NONE
        open_ = np.flatnonzero((seen != keys) & (seen >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class ByteBPE:
    """A rank file and its split pattern."""

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.bytes_ = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs, self.pattern, self.limit = PairTable(self.tokens, self.ids), regex.compile(pattern), limit
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ends, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ids.get(p)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                width = len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length()
                buckets.setdefault(width, []).append(i)
        for width, members in buckets.items():
            step = max(1, min(ROWS, (1 << 22) // max(width, 1)))
            for low in range(0, len(members), step):
                some = members[low : low + step]
                for i, ids in zip(some, self._merge_bucket([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge_bucket(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < length[:, None], self.bytes_[raw], np.int32(-1))
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out: list = [None] * len(pieces)
        alive = np.arange(len(pieces))
        while len(alive):
            if not ranks.shape[1]:
                for r, row in zip(alive, ids):
                    out[r] = row[row >= 0]
                break
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(j)), j]
            done = best == NONE
            if done.any():
                for r, row in zip(alive[done], ids[done]):
                    out[r] = row[row >= 0]
                go = ~done
                alive, ids, ranks, j, best = alive[go], ids[go], ranks[go], j[go], best[go]
                if not len(alive):
                    break
            n = np.arange(len(j))
            ids[n, j] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= j[:, None], ids[:, :-1], ids[:, 1:])
            columns = columns[:-1]
            ranks = np.where(columns < j[:, None], ranks[:, :-1], ranks[:, 1:])
            for side in (j - 1, j):  # the pairs that the merged token is part of
                ok = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                s = side[ok]
                ranks[ok, s] = self.pairs.find(ids[ok, s], ids[ok, s + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.bytes_[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            starts = np.concatenate([[True], np.diff(at) > 1])  # of overlapping pairs, every other one merges
            at = at[(at - at[starts][np.cumsum(starts) - 1]) % 2 == 0]
            ahead = at[at + 2 < len(ids)] + 2
            if len(at) > 1 and (self.pairs.find(np.full(len(ahead), best), ids[ahead]) < best).any():
                at = at[:1]  # a new pair would go before the other places
            new, place = self._with_merged(ids, at, best)
            if len(at) > 1 and (self.pairs.find(new[place[place > 0] - 1], new[place[place > 0]]) < best).any():
                at = at[:1]
                new, place = self._with_merged(ids, at, best)
            ids, ranks = new, np.delete(ranks, at)
            touched = np.concatenate([place[place > 0] - 1, place[place < len(ranks)]])
            ranks[touched] = self.pairs.find(ids[touched], ids[touched + 1])
        return ids

    @staticmethod
    def _with_merged(ids: np.ndarray, at: np.ndarray, merged: np.int32) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the pairs at these places merged, the new places)"""
        new = ids.copy()
        new[at] = merged
        return np.delete(new, at + 1), at - np.arange(len(at))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends): text i has ids[ends[i]:ends[i + 1]]."""
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.rows) > self.limit:
            self.forget()
        new = list(set().union(*cut).difference(self.rows))
        if new:
            made = self.merge([p.encode() for p in new])
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in made])])
            self.flat = np.concatenate([self.flat, *made])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter((r for pieces in cut for r in map(self.rows.__getitem__, pieces)), np.int64, int(n.sum()))
        start, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(n)])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def loaded(path: str, pattern: str) -> ByteBPE:
    """One for each worker process."""
    return ByteBPE(path, pattern)


def small_lists(column: list, chars: int = FRESH_CHARS) -> Iterator[tuple[int, list]]:
    """(first index, texts) of runs with about so many characters, so that temporaries stay small; null is empty."""
    low, size = 0, 0
    for i, x in enumerate(column):
        size += len(x or "")
        if size >= chars or i + 1 == len(column):
            yield low, [y or "" for y in column[low : i + 1]]
            low, size = i + 1, 0


def in_runs(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[ByteBPE, pa.Array, np.ndarray, np.ndarray]]:
    """(vocabulary, ids of the texts, then as ``encode``) of runs of a task's rows of an id and a text."""
    bpe = loaded(path, pattern)
    try:
        for batch in batches:
            for low, texts in in_parts(batch.column(1)):
                yield bpe, batch.column(0).slice(low, len(texts)), *bpe.encode(texts)
    finally:
        bpe.forget()


def encoded(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every text as little-endian unsigned 32-bit integers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, ids, ends in in_runs(it, path, pattern):
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([names, pa.array(raw, pa.binary())], ["id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, "id long, ids binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(df: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to; on demand the ids as in ``encoded``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bpe, names, ids, ends in in_runs(it, path, pattern):
            each = [ids[a:b] for a, b in zip(ends, ends[1:])]
            columns = [
                names,
                pa.array([len(x) for x in each], pa.int64()),
                pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                pa.array([sha256(bpe.decode(x)).hexdigest() for x in each], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([x.astype("<u4").tobytes() for x in each], pa.binary()))
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, DIGESTS + ", ids binary" * with_ids)


def default_vocabulary() -> tuple[str, str]:
    """(rank file, pattern) of the multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_vocabulary())
