import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import token_records, warc
from tallyforge.llm.common import fresh_path, local_path


def test_streams_become_members(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    archives = warc.write_archives(pages, raw)
    index = warc.normalise(spark, raw, archives, clean)
    got = {r["page_id"]: r for r in warc.read_records(index, clean).collect()}
    rows = pages.collect()
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    first = {}
    for i, p in sorted(payloads.items()):
        first.setdefault(p, i)
    assert len(got) == len(rows) == index.count() == sum(r["n_records"] for r in archives.collect())
    for i, p in payloads.items():
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[p] == i else ("revisit", first[p]))
    files, base = local_path(clean)
    row = index.first()
    with files.open_input_file(f"{base}/{row['archive']}") as f:
        whole = f.read()
    member = whole[row["offset"] : row["offset"] + row["length"]]
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and gzip.decompress(member) in gzip.decompress(whole)


def test_op1(spark, sf_dir):
    assert warc.op1_warc(spark, sf_dir).count() == 150


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK - 1, warc.CHUNK, warc.CHUNK + 1, 3 * warc.CHUNK])
def test_inflating_in_chunks(size):
    body = random.Random(size).randbytes(size // 2) + b"a" * (size - size // 2)
    for packed in (gzip.compress(body), gzip.compress(body[:10]) + gzip.compress(body[10:]) + b"\0\0"):
        assert b"".join(warc.inflated(io.BytesIO(packed))) == body
    with pytest.raises(ValueError, match="cut off"):
        list(warc.inflated(io.BytesIO(gzip.compress(body)[:-9])))


def test_odd_pages(spark):
    rows = [(None, None, None), (None, "u", "x"), (2, "http://a b\r\nX: y", "x"), (2, "u", "x"), (1, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS first")
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    out = warc.read_records(warc.normalise(spark, raw, warc.write_archives(pages, raw), clean), clean).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in out) == [
        ("1", 0, "response", "None"), ("2", 1, "response", "None"), ("2", 1, "response", "None"), ("5", 14, "response", "None"), ("None", 0, "revisit", "1"), ("None", 1, "revisit", "2"),
    ]
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    assert warc.read_records(warc.normalise(spark, raw, warc.write_archives(pages.limit(0), raw), clean), clean).count() == 0


def test_crc32c():
    assert [int(x) for x in token_records.crc32c([b"123456789", b"", b"a", bytes(32)])] == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]
    table = token_records._byte_table()

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc = int(table[(crc ^ b) & 255]) ^ crc >> 8
        return crc ^ 0xFFFFFFFF

    r = random.Random(1)
    parts = [r.randbytes(n) for n in (0, 1, 3, 63, 64, 65, 200, 1000, 5000)]
    assert token_records.crc32c(parts).tolist() == list(map(plain, parts))


def test_damage_is_found():
    whole = b"".join(token_records.framed([b"abc", b"", b"x" * 300]))
    assert [p for some in token_records.records(io.BytesIO(whole)) for p in some] == [b"abc", b"", b"x" * 300]
    for at in (0, 8, 13, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(Exception):
            list(token_records.records(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_records.records(io.BytesIO(whole[:-1])))


def test_records_come_back(spark, odd_docs, no_docs):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(spark, "records")
    index = token_records.write_records(odd_docs, folder, lambda: token_records.chunk_encoder(vocabulary))
    got = sorted(token_records.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    library, start = Tokenizer.from_file(vocabulary), 0
    for r, g in zip(rows, got, strict=True):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert tuple(g) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_records.fetch(spark, folder, index.where("doc_id = 3")).collect()
    assert [r["ids"] for r in one] == [[*library.encode("word", add_special_tokens=False).ids, 1]] * 3
    empty = fresh_path(spark, "records")
    token_records.write_records(no_docs, empty, lambda: token_records.chunk_encoder(vocabulary))
    assert token_records.read_digests(spark, empty).count() == 0


def test_wide_ids():
    for ids in ([], [5, 65535], [5, 65536, 2**32 - 1]):
        for doc_id in (None, 0, -7, 2**62):
            back, found = token_records.unpacked(token_records.packed(doc_id, np.array(ids, np.uint32)))
            assert back == doc_id and found.tolist() == ids


def test_chunks_equal_whole_texts():
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    ours, library, r = token_records.ChunkEncoder(vocabulary), Tokenizer.from_file(vocabulary), random.Random(2)
    texts = ["ΑΣ ΟΔΟΣ.", "é\u0301 a<|endoftext|>b  x\x85y", "日本 don't I'LL 123", "İstanbul ǅ", "\x1c\x1d a", "A|b || |", "<|StartOfText|> A", "a\xa0B c"]
    texts += ["WORD,", "word.,!", "(word).", "a1.", "don't!", "x.. y", "ΟΔΟΣ: α", "e\u0301.", "a|b.", "| |.", ".", "!?", "né,né", "<|endoftext|>.", "ﬁ."]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), 0x1F600 + r.randint(0, 60), 9, 10, 32])) for _ in range(r.randint(1, 300))) for _ in range(200)]
    for t, ids in zip(texts, ours(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_get_whole_texts():
    """A vocabulary that keeps white space and capitals is not cut into chunks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = token_records.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["Two  words, One LINE\n", "", "a|b <|endoftext|>"]
    assert not ours.by_chunks and token_records.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).by_chunks
    assert [x.tolist() for x in ours(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op6_against_the_library(spark, sf_dir):
    """The query itself: places, lengths and checksums of all documents in ascending order."""
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_records.op6_token_records(spark, sf_dir).collect()} == want
