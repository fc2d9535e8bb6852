"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is framed as in TFRecord files: length (unsigned 64 bits), masked CRC-32C of the length, payload, masked CRC-32C
of the payload, all little-endian. The payload is a header (doc_id, flags) and the ids, as 16-bit numbers when the
vocabulary allows it, else 32-bit. Shards are ranges of doc_id in ascending order, written by the tasks that hold the
range under names no other attempt uses; the index, a Parquet table committed by Spark, names the shards that count, so a
repeated or lost task leaves no trace in results. Each index row has the place of one record, so a reader may fetch
records in any order.

Defined cases: a null text counts as empty and its record holds the end id alone; null ids come first; ties and repeated
rows sort by text and each has its record; an empty table gives an empty index and no shards; other columns are not
looked at. Strings of special tokens in a text become special tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import small_lists
from .common import fresh_path, local_path, partitions, table

SHARD_BYTES = 256 << 20
END_ID = 1
HEAD = struct.Struct("<qB")
NULL_ID, WIDE = 1, 2

# CRC-32C (Castagnoli), for many byte strings at once.
BLOCK = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as four tables of the images of single bytes."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(image of a byte at each place of a block, shift by 2 ** k zero bytes for each k)."""
    byte = _byte_table()
    places = np.empty((BLOCK, 256), np.uint32)
    places[-1] = byte
    for p in range(BLOCK - 2, -1, -1):
        places[p] = byte[places[p + 1] & 255] ^ (places[p + 1] >> np.uint32(8))
    units = np.arange(256, dtype=np.uint32)
    shift = np.stack([byte[x & 255] ^ (x >> np.uint32(8)) for x in (units << np.uint32(8 * i) for i in range(4))])
    shifts = [shift]
    for _ in range(40):
        shifts.append(np.stack([_apply(shifts[-1], x) for x in shifts[-1]]))
    return places, np.stack(shifts)


def _shifted(crc: np.ndarray, count: np.ndarray, first: int) -> np.ndarray:
    """Registers after count * 2 ** first zero bytes."""
    shifts, k = _crc_tables()[1], 0
    while len(count) and int(count.max()) >> k:
        on = np.flatnonzero(count >> k & 1)
        crc[on] = _apply(shifts[first + k], crc[on])
        k += 1
    return crc


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-length // BLOCK)
    raw = np.frombuffer(b"".join(p.rjust(n * BLOCK, b"\0") for p, n in zip(parts, blocks.tolist())), np.uint8).reshape(-1, BLOCK)
    places = _crc_tables()[0]
    crc = np.zeros(len(raw), np.uint32)
    for p in range(BLOCK):
        crc ^= places[p][raw[:, p]]
    ends = np.cumsum(blocks)
    crc = _shifted(crc, np.repeat(ends, blocks) - 1 - np.arange(len(raw)), BLOCK.bit_length() - 1)
    out = np.zeros(len(parts), np.uint32)
    full = np.flatnonzero(blocks)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(crc, (ends - blocks)[full])
    return out ^ _shifted(np.full(len(parts), 0xFFFFFFFF, np.uint32), length, 0) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums of checksums are weak, so stored ones are rotated and shifted."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def framed(payloads: list[bytes]) -> list[bytes]:
    """Whole records."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((n, struct.pack("<I", x), p, struct.pack("<I", y))) for n, x, p, y in zip(lengths, a, payloads, b)]


def records(stream, batch_bytes: int = 4 << 20) -> Iterator[list[bytes]]:
    """Payloads of a shard in lists of bounded size, checksums verified."""
    heads, payloads, sums, size = [], [], [], 0
    while True:
        head = stream.read(12)
        if head:
            (n,) = struct.unpack("<Q", head[:8])
            rest = stream.read(n + 4)
            if len(head) < 12 or len(rest) < n + 4:
                raise ValueError("a record is cut off")
            heads.append(head), payloads.append(rest[:n]), sums.append(rest[n:])
            size += n
        if payloads and (not head or size >= batch_bytes):
            stored = np.frombuffer(b"".join(h[8:] for h in heads), "<u4"), np.frombuffer(b"".join(sums), "<u4")
            if (masked(crc32c([h[:8] for h in heads])) != stored[0]).any() or (masked(crc32c(payloads)) != stored[1]).any():
                raise ValueError("a checksum does not fit")
            yield payloads
            heads, payloads, sums, size = [], [], [], 0
        if not head:
            return


def packed(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A payload."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return HEAD.pack(doc_id or 0, NULL_ID * (doc_id is None) + WIDE * wide) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = HEAD.unpack_from(payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=HEAD.size)


class Rows(dict):
    """Numbers keys in the order they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = row = len(self)
        self.new.append(key)
        return row

    def taken(self) -> list:
        """Keys numbered since the last call."""
        new, self.new = self.new, []
        return new


class IdTable:
    """Token ids of keys, kept in one flat array."""

    def __init__(self):
        self.rows, self.ends, self.flat = Rows(), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def gathered(self, keys: Iterable, n: int, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of n keys, where each ends); encode gives (all ids, how many for each) of new keys."""
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, n)
        if new := self.rows.taken():
            made, sizes = encode(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, made])
        start, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


class ChunkEncoder:
    """The tokenizers library over chunks between ASCII white space; frequent chunks are encoded once.

    A chunk is cut again before the punctuation that ends it, so most new chunks are known words with a mark. New pieces without a bar
    go to the library many at a time, with bars between them. All of this holds for vocabularies that normalise and cut as
    SHAPE says (lower case, white space dropped, words apart from marks) and give a bar one id; with any other the library gets whole texts.
    """

    BAR, JOINED, MARKS = "|", 256, ".,;:!?*#%&$"
    #: How the word vocabulary describes its normaliser and its cutting of texts.
    SHAPE = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None, "truncation": None, "padding": None,
    }

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        shape, bar = json.loads(self.tokenizer.to_str()), self.tokenizer.encode(self.BAR, add_special_tokens=False).ids
        self.by_chunks = len(bar) == 1 and all(shape[k] == v for k, v in self.SHAPE.items())
        self.bar = bar[0] if bar else None
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.pieces = IdTable(), IdTable()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        barred = np.array([self.BAR in p for p in pieces])
        if barred.any():  # few: each is a text of its own
            out: list = [None] * len(pieces)
            for want, of in ((True, self._alone), (False, self._joined)):
                at = np.flatnonzero(barred == want)
                made, sizes = of([pieces[i] for i in at])
                for i, ids in zip(at, np.split(made, np.cumsum(sizes)[:-1])):
                    out[i] = ids
            return np.concatenate(out), np.array(list(map(len, out)), np.int64)
        return self._joined(pieces)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self._library(pieces)
        return np.array([i for x in made for i in x], np.uint32), np.array(list(map(len, made)), np.int64)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [pieces[i : i + self.JOINED] for i in range(0, len(pieces), self.JOINED)]
        ids = np.array([i for x in self._library([f" {self.BAR} ".join((*g, "")) for g in groups]) for i in x], np.uint32)
        bars = np.flatnonzero(ids == self.bar)
        return np.delete(ids, bars), np.diff(bars, prepend=-1) - 1

    def _of_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces = []
        for chunk in map(bytes.decode, chunks):
            word = chunk.rstrip(self.MARKS)
            pieces += (word, chunk[len(word) :]) if word and word[-1].isalpha() else (chunk, "")
        ids, upto = self.pieces.gathered(pieces, len(pieces), self._of_pieces)
        return ids, np.diff(upto[::2])

    @staticmethod
    def plain(text: str) -> str:
        """Lower case where that cannot change ids: Latin-1 texts (all composed) without strings of special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeError:
            return text
        return text if "<|" in text else text.lower()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_chunks:
            return [np.array(x, np.uint32) for x in self._library(texts)]
        if len(self.chunks.rows) > self.limit:
            self._forget()
        cut = [self.plain(t).encode().split() for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        ids, upto = self.chunks.gathered(chain.from_iterable(cut), int(n.sum()), self._of_chunks)
        at = upto[np.concatenate([[0], np.cumsum(n)])]
        return [ids[a:b] for a, b in zip(at, at[1:])]


@lru_cache(2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each worker process."""
    return ChunkEncoder(path)


INDEX = "doc_id long, shard string, offset long, length long, n_tokens long"


def write_records(df: DataFrame, folder: str, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int = END_ID) -> DataFrame:
    """Write (doc_id, text) rows of df into shards under folder, in ascending doc_id order, and return the index.

    encoder makes, on an executor, a function from texts to ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, files, base = encoder(), *local_path(folder)
        files.create_dir(base, recursive=True)
        task, attempt, shards, at, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, 0, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for low, texts in small_lists(batch.column(1).to_pylist()):
                if out is None or at >= SHARD_BYTES:
                    if out is not None:
                        out.close()
                    name, at, shards = f"shard-{task:06d}-{shards:04d}-{attempt}.rec", 0, shards + 1
                    out = files.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                doc_ids = batch.column(0).slice(low, len(texts))
                each = [np.concatenate([x, end]) for x in encode(texts)]
                whole = framed([packed(d, x) for d, x in zip(doc_ids.to_pylist(), each)])
                sizes = list(map(len, whole))
                out.write(b"".join(whole))
                offsets = at + np.cumsum([0, *sizes[:-1]])
                at += sum(sizes)
                n = [len(x) for x in each]
                yield pa.record_batch([doc_ids, pa.array([name] * len(n)), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "shard", "offset", "length", "n_tokens"])
        if out is not None:
            out.close()

    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


TOLD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, read from the shards of an index: its place among all ids, its length and the CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_path(folder)
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(f"{base}/{shard}", buffer_size=1 << 20) as stream:
                    for payloads in records(stream):
                        rows = []
                        for doc_id, ids in map(unpacked, payloads):
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return shards.repartitionByRange(2 * partitions(spark), "shard").mapInArrow(read, TOLD)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the index rows wanted, fetched by offset in any order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_path(folder)
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                with files.open_input_file(f"{base}/{shard}") as f:
                    f.seek(offset)
                    (payload,) = next(records(pa.BufferReader(f.read(length))))
                    found.append(unpacked(payload))
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b.tolist() for _, b in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return wanted.select("shard", "offset", "length").mapInArrow(read, "doc_id long, ids array<long>")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as records of token ids and tell what reading them back gives."""
    import public_tokenizers

    vocabulary, folder = public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, lambda: chunk_encoder(vocabulary))
    return read_digests(spark, folder)
