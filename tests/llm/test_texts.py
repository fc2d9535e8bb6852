import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyforge.llm import byte_bpe, chat_format, spot_signatures


def jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def read(fingerprint):
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").tolist()


def test_fingerprints_against_brute_force(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in spot_signatures.op2_spot_signatures(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    sign = lambda t: spot_signatures.signatures(t, spot_signatures.SpotTable()).tolist()
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert read(r["fingerprint"]) == sign(text) and read(r["edited_fingerprint"]) == sign(edited)
        assert r["near_edited"] == pytest.approx(jaccard(sign(text), sign(edited))) and r["near_next"] == pytest.approx(jaccard(sign(text), sign(after)))


def test_signatures_follow_anchors():
    words = spot_signatures.SpotTable()
    one = spot_signatures.signatures("The quick fox, and the lazy dog ran", words)
    assert len(one) == 3  # the + quick fox, and + lazy dog, the + lazy dog
    assert len(spot_signatures.signatures("x and y", words)) == 1 and len(spot_signatures.signatures(" \n", words)) == 0
    same = lambda a, b: spot_signatures.signatures(a, words).tolist() == spot_signatures.signatures(b, words).tolist()
    assert same("THE Quick, (fox)", "the quick fox") and not same("alpha beta", "beta alpha")


def test_odd_fingerprints(spark, odd_docs, no_docs):
    rows = spot_signatures.fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["near_next"] <= 1 for r in rows)
    assert spot_signatures.fingerprints(no_docs).count() == 0
    one = spot_signatures.fingerprints(odd_docs.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def test_near_pairs_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r["doc_id"]: frozenset(spot_signatures.signatures(r["text"], spot_signatures.SpotTable()).tolist()) for r in docs.collect()}
    for threshold in (0.5, 0.8):
        members, pairs = spot_signatures.near_pairs(docs, threshold)
        reps = {s: min(i for i, x in sets.items() if x == s) for s in sets.values()}
        assert {r["doc_id"]: r["rep"] for r in members.collect()} == {i: reps[s] for i, s in sets.items()}
        want = {(min(a, b), max(a, b)) for s, a in reps.items() for t, b in reps.items() if a < b and jaccard(s, t) >= threshold}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


def library():
    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_against_the_library(spark, odd_docs, no_docs, sf_dir):
    known = library()
    r = random.Random(3)
    texts = [x["text"] or "" for x in odd_docs.collect()] + ["don't we'll 123456  \t\n", "ab" * 700 + "日本" * 100, " " * 300 + "q"]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x3040, 0x30FF), 0x1F600, 9, 10, 32])) for _ in range(r.randint(1, 200))) for _ in range(150)]
    texts += ["".join(r.choices("abcdeinorst", k=n)) for n in (257, 1000, 30_000)] + ["a" * 20_001, "abab" * 3000 + "b", "the" * 2000, "é日" * 3000]
    bpe = byte_bpe.loaded(*byte_bpe.default_vocabulary())
    ids, ends = bpe.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == known.encode_ordinary(t) and bpe.decode(ids[a:b]) == t.encode()
    for x in byte_bpe.op5_byte_bpe(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect():
        want = np.array(known.encode_ordinary(x["text"]), "<u4")
        assert (x["n_tokens"], x["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(x["text"].encode()).hexdigest()
    assert byte_bpe.round_trip(odd_docs, *byte_bpe.default_vocabulary()).count() == odd_docs.count()
    assert byte_bpe.encoded(no_docs, *byte_bpe.default_vocabulary()).count() == 0


def test_both_ways_meet_at_the_longest_piece_of_the_matrix():
    """Pieces of LONG bytes and around it: the matrix, the way of longer pieces and the library agree."""
    known, bpe, r = library(), byte_bpe.loaded(*byte_bpe.default_vocabulary()), random.Random(6)
    for n in (byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1):
        for letters in ("ab", "abcdeinorst", "a", "thean"):
            piece = "".join(r.choices(letters, k=n)).encode()
            (matrix,), want = bpe._merge_bucket([piece], len(piece)), known.encode_ordinary(piece.decode())
            assert matrix.tolist() == bpe._merge_long(piece).tolist() == bpe.merge([piece])[0].tolist() == want


def test_a_full_table_starts_anew():
    path, pattern = byte_bpe.default_vocabulary()
    small = byte_bpe.ByteBPE(path, pattern, limit=3)
    for _ in range(3):
        ids, ends = small.encode(["alpha beta gamma delta", "epsilon zeta"])
        assert small.decode(ids) == b"alpha beta gamma deltaepsilon zeta"


def test_a_worker_forgets_the_pieces_of_a_task():
    """A worker process lives on after a task and does other work: only the vocabulary stays with it."""
    path, pattern = byte_bpe.default_vocabulary()
    batch = pa.record_batch([pa.array([1, 2, None]), pa.array(["alpha beta", None, "gammadelta"])], ["id", "text"])
    for some in ([batch], [batch, batch], []):
        runs = list(byte_bpe.in_runs(iter(some), path, pattern))
        bpe = byte_bpe.loaded(path, pattern)
        assert [i for _, names, _, _ in runs for i in names.to_pylist()] == [1, 2, None] * len(some)
        assert b"".join(bpe.decode(ids) for _, _, ids, _ in runs) == b"alpha betagammadelta" * len(some)
        assert not bpe.rows and not len(bpe.flat)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", "<turn> \\ </turn>\n"), (1, 3, "assistant", ""), (1, 4, None, None),
        (2, None, "assistant", "<say>\\"), (2, 0, "a<say>b\\", "x"), (2, 0, "a<say>b\\", "x"), (None, 1, "assistant", "😀 é"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS blocks", "2 AS pieces")
    out = chat_format.format_conversations(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert back == {
        1: [("user", "hi"), ("user", "again"), ("assistant", "<turn> \\ </turn>\n"), ("assistant", ""), ("", "")],
        2: [("assistant", "<say>\\"), ("a<say>b\\", "x"), ("a<say>b\\", "x")],
        None: [("assistant", "😀 é")],
    }
    one = {r["conv_id"]: r for r in out.collect()}[1]
    spans = [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]]
    assert len(spans) == 2 and spans[0].replace("<\\", "<").replace("\\\\", "\\") == "<turn> \\ </turn>\n" and spans[1] == ""
    assert one["formatted"].count("<turn>") == 3  # adjacent turns of one role share a block
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    """16,000 turns, escapes and code points beyond the first plane; all spans read back what was said."""
    rows = spark.range(16_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 < 5 THEN 'assistant' ELSE 'user' END AS role", "concat('<', id, '> \U0001f600 \\\\') AS text")
    out = chat_format.format_conversations(rows).select(chat_format.under_spans(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat_format.read_turns(F.col("formatted")).alias("turns"))
    got = out.select(F.transform("loss", chat_format.unescape).alias("loss"), "turns").first()
    said = [r["text"] for r in rows.orderBy("turn").collect()]
    assert [t["text"] for t in got["turns"]] == said and got["loss"] == [x for i, x in enumerate(said) if i % 7 < 5]
