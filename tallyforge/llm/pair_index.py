"""Byte-level BPE by merge lists, over an index of where each pair of symbols occurs.

The texts of a window of a partition (about WINDOW characters) are cut into pieces, and each distinct new piece becomes a run of
symbols in one array, linked to its neighbours. The index maps a pair that has a rank to all its places in that array. The least active
rank is taken, all its places merge at once, from left to right where they overlap, and the pairs that the merged symbols now
form are filed under their own ranks; a place whose pair is gone by the time its rank comes is passed over. So the work
follows the merges that happen, and not the length of any piece: one piece of a megabyte is as cheap as many short ones.

Merging all places of a rank at once is the same as going piece by piece as long as no merge makes a pair of lower rank, which holds if
every rank comes after those that make its two symbols. Merge lists where it does not hold merge the first place of each piece only and file the
rest again.

The file's added tokens are cut out of the texts first; truncation and padding of the file are not used. Texts are cut by the pattern of byte-level
vocabularies, with the letters and numbers that the tokenizers library knows: characters of later Unicode versions count as neither.

Defined cases: a null text counts as empty and has no ids; very long pieces and texts are whole; repeated rows are encoded alike; an
empty table gives an empty result; other columns are not looked at. A file that is not a plain byte-level BPE is refused.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 1 << 22
NONE = np.int32(2**31 - 1)
#: The pattern of byte-level vocabularies, fixed.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if it is printable, else the next one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def newer_letters() -> str:
    """Characters that the pattern takes for letters or numbers and the tokenizers library, with an older Unicode version, does not.

    Only characters on which this Python's own version and the pattern's differ can be such.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split, word = ByteLevel(add_prefix_space=False), regex.compile(r"[\p{L}\p{N}]")
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    taken = set(word.findall("".join(every)))
    doubtful = [c for c in every if c in taken and unicodedata.category(c)[0] not in "LN"]
    return "".join(c for c in doubtful if len(split.pre_tokenize_str(f"!{c}!")) == 1)


class Cutter:
    """Texts to pieces; added tokens become their ids."""

    def __init__(self, added: dict[str, int]):
        self.added, self.pattern = added, regex.compile(PATTERN)
        longest_first = sorted(added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        newer = newer_letters()
        self.newer = frozenset(newer)
        self.plain = dict.fromkeys(map(ord, newer), "�")  # neither letter nor number

    def pieces(self, text: str) -> list[str | int]:
        if self.marks is None or not self.marks.search(text):
            return self._cut(text)
        out: list[str | int] = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                out.append(self.added[part])
            else:
                out.extend(self._cut(part))
        return out

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and not self.newer.isdisjoint(text):
            return [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.plain))]
        return self.pattern.findall(text)


class Merges:
    """The merge list: (left, right) to rank, looked up in whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.left, self.right, self.merged = left, right, merged
        keys = left.astype(np.int64) << 32 | right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.ranks], np.iinfo(np.int64).max)
        self.ranks = np.append(self.ranks, 0).astype(np.int32)
        made = np.full(int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1, -1, np.int64)
        np.maximum.at(made, merged, np.arange(len(merged)))
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(left))).all())

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


class PairIndexBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, encoding="utf-8") as f:
            self._read(json.load(f))
        self.limit = limit
        self._forget()

    def _read(self, file: dict) -> None:
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (file.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE: {odd or 'normalizer, pre-tokenizer or decoder'}")
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        if any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at what stands beside them")
        ids, letters = model["vocab"], alphabet()
        if missing := [c for c in letters if c not in ids]:
            raise ValueError(f"bytes without a token: {missing}")
        byte_of = sorted(letters.items(), key=lambda x: x[1])
        self.bytes_ = np.array([ids[c] for c, _ in byte_of], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        column = lambda items: np.array(list(items), np.int64)
        self.merges = Merges(column(ids[a] for a, _ in pairs), column(ids[b] for _, b in pairs), column(ids[a + b] for a, b in pairs))
        self.tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in [*ids.items(), *added.items()]:
            self.tokens[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.decimals = list(map(str, range(len(self.tokens))))
        self.cutter = Cutter(added)

    def _forget(self) -> None:
        added = list(self.cutter.added.values())
        self.rows: dict[str | int, int] = dict(zip(added, range(len(added))))
        self.ends, self.flat = np.arange(len(added) + 1), np.array(added, np.int32)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each piece has)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.bytes_[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(size)
        ahead, behind = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        ahead[ends[size > 0] - 1] = -1
        behind[(ends - size)[size > 0]] = -1
        piece = np.repeat(np.arange(len(pieces)), size)
        self._merge_all(ids, ahead, behind, piece)
        alive = ids >= 0
        return ids[alive], np.bincount(piece[alive], minlength=len(pieces))

    def _merge_all(self, ids: np.ndarray, ahead: np.ndarray, behind: np.ndarray, piece: np.ndarray) -> None:
        """ids of merged symbols are -1; ahead and behind link those that are left."""
        find, left, right, merged, ordered = self.merges.find, self.merges.left, self.merges.right, self.merges.merged, self.merges.ordered
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def filed(places: np.ndarray) -> None:
            """Enter the pairs that start at these places, ascending."""
            ranks = find(ids[places], ids[ahead[places]])
            known = ranks != NONE
            places, ranks = places[known], ranks[known]
            if not len(places):
                return
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heappush(active, rank)

        filed(np.flatnonzero(ahead >= 0))
        heapify(active)
        while active:
            rank = heappop(active)
            lists = index.pop(rank)
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            second = ahead[at]
            held = (ids[at] == left[rank]) & (second >= 0) & (ids[second] == right[rank])
            if not held.all():
                at, second = at[held], second[held]
            if left[rank] == right[rank] and len(at) > 1:  # of places that overlap every other one merges
                starts = np.concatenate([[True], second[:-1] != at[1:]])
                run = np.flatnonzero(starts)
                keep = (np.arange(len(at)) - run[np.cumsum(starts) - 1]) % 2 == 0
                if ordered:
                    at, second = at[keep], second[keep]
            if not ordered and len(at) > 1:
                first = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
                if not first.all():
                    index[rank] = [at[~first]]
                    heappush(active, rank)
                    at, second = at[first], second[first]
            if not len(at):
                continue
            after = ahead[second]
            ids[at], ids[second] = merged[rank], -1
            ahead[at] = after
            inner = after >= 0
            behind[after[inner]] = at[inner]
            before = behind[at]
            before = before[before >= 0]
            touched = np.concatenate([before, at[inner]])
            if len(touched) > 1:
                touched = np.unique(touched)
            if len(touched):
                filed(touched)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends): text i has ids[ends[i]:ends[i + 1]]."""
        cut = list(map(self.cutter.pieces, texts))
        if len(self.rows) > self.limit or len(self.flat) > 16 * self.limit:
            self._forget()
        new = list(set().union(*cut).difference(self.rows))
        if new:
            ids, size = self.merged([p.encode() for p in new])
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, ids])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter((r for pieces in cut for r in map(self.rows.__getitem__, pieces)), np.int64, int(n.sum()))
        start, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(n)])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids.tolist()))


@lru_cache(2)
def loaded(path: str) -> PairIndexBPE:
    """One for each worker process."""
    return PairIndexBPE(path)


def windows(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of runs of a partition's rows with about so many characters; null is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        low, column = 0, batch.column(1).to_pylist()
        for i, text in enumerate(column):
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chars:
                ids.append(batch.column(0).slice(low, i + 1 - low))
                yield pa.concat_arrays(ids), texts
                ids, texts, size, low = [], [], 0, i + 1
        ids.append(batch.column(0).slice(low))
    if texts:
        yield pa.concat_arrays(ids), texts


ENCODED = "id long, n_tokens long, ids binary, decoded string"
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _each(df: DataFrame, path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    """A row for each text; row gives the columns after the id and n_tokens, from the vocabulary and the text's ids."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        types = [pa.binary() if "binary" in f else pa.string() for f in schema.split(", ")[2:]]
        names = [f.split()[0] for f in schema.split(", ")]
        for ids, texts in windows(it, WINDOW):
            flat, ends = bpe.encode(texts)
            rows = [row(bpe, flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([ids, pa.array(np.diff(ends)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(batches, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, the ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    return _each(df, path, id_col, text_col, ENCODED, lambda bpe, ids: (ids.astype("<u4").tobytes(), bpe.decode(ids)))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and digests of the decimal ids and of the decoded text, taken where the ids are made."""
    hexed = lambda text: sha256(text.encode()).hexdigest()
    return _each(df, path, id_col, text_col, DIGESTS, lambda bpe, ids: (hexed(bpe.listed(ids)), hexed(bpe.decode(ids))))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary()).withColumnRenamed("id", "doc_id")
