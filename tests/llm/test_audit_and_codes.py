import hashlib
import json
import random
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import filter_audit, pair_index, vector_codes


# -- filter audit


def audited(rows, labels):
    """The audit by applying the filters one after another."""
    words = [(i, (t or "").replace("\x0b", " ").replace("\x0c", " "), lang or "") for i, t, lang in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for (i, _, part), (_, t, _) in zip(words, rows):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        fails.append((part, i, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in least and i > least[t]}))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                failing = sum(x[1][f] for x in mine)
                only = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_filters_in_turn(spark):
    r, texts = random.Random(5), ["", None, "A", "a # b", "Word " * 300, " ".join(f"w{i}" for i in range(260)), " ".join(f"W{i}" for i in range(260)) + " |", "one\x0btwo\x0cthree\x1cfour", "é" * 90 + "ABC", "é" * 100 + "ABC"]
    texts += [" ".join(r.choice(("alpha", "beta", "$", f"x{r.random()}")) for _ in range(r.choice((40, 250)))) for _ in range(30)]
    docs = [(r.choice((None, *range(60))), r.choice(texts), r.choice((None, "", "en", "fr"))) for _ in range(150)] + [(7, texts[5], "en")] * 3
    labels = [(r.choice((None, *range(60))), r.choice((0, 1, None)), r.choice((0, 1, None))) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS digest", "3 AS words").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 AS good")
    assert found(filter_audit.audit(frame, marks)) == audited(docs, labels)


def test_audit_of_odd_and_no_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    assert found(filter_audit.audit(odd_docs, labels)) == audited(rows, [])
    assert filter_audit.audit(no_docs, labels).count() == 0


def test_outcome_matrices():
    m = filter_audit.outcomes()
    assert all(m[k].shape == (32, 600) and m[k].dtype == np.int64 for k in ("kept", "removed", "redundant", "unique_fails"))
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all() and not m["removed"][0].any()  # one step removes each document that fails
    large = np.zeros((1, 3, 32), np.int64)
    large[0, :, 31] = (1 << 55) + 1  # beyond the integers that doubles hold
    assert set(filter_audit.multiplied(large)[0, :, 6].tolist()) == {24 * ((1 << 55) + 1)}


# -- vector codes


def searched(rows):
    """Lloyd rounds by full search in Python integers: {place of a kept row: (code, error)}, the entries."""
    held = [(k, i, v) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in held), default=0) // 8)
    ints = {k: [int(np.floor(4096 * np.float64(x))) for x in v] + [0] * (8 * width - len(v)) for k, _, v in held}
    first = [k for k, _, _ in sorted(held, key=lambda x: (x[1] is None, x[1] or 0, x[2]))][:16]
    part = lambda k, p: ints[k][p * width : (p + 1) * width]
    books = [[part(k, p) for k in first] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            members = [[] for _ in books[p]]
            for k in ints:
                members[nearest(part(k, p), books[p])[1]].append(part(k, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])]
    best = {k: [nearest(part(k, p), books[p]) for p in range(8)] for k in ints}
    return {k: ("".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for k, b in best.items()}, books


def check_codes(spark, rows, dims="array<float>"):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"place long, vec_id long, embedding {dims}, label int")
    out, entries = vector_codes.compressed(frame.selectExpr("vec_id", "embedding", "label", "place AS state", "1 AS vector", "2 AS sums").repartition(3))
    want, books = searched(rows)
    assert sorted((str(rows[k][0]), str(rows[k][2]), *v) for k, v in want.items()) == sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in out.collect())
    assert entries.tolist() == books


def test_codes_against_full_search(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(24, 24))
    rows = [(int(i), (centres[i % 24] + r.normal(size=24) * 0.2).astype(np.float32).tolist(), int(i) % 5) for i in r.permutation(500)]
    check_codes(spark, rows)


def test_codes_with_ties(spark):
    r = np.random.default_rng(5)  # few values: many parts lie as near to two entries
    check_codes(spark, [(int(i), (r.integers(-1, 2, 16) / 4096).tolist(), None) for i in range(300)])


def test_codes_of_odd_vectors(spark):
    r = random.Random(6)
    some = lambda n: [r.uniform(-2, 2) for _ in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, some(9), 1), (None, some(8), None), (3, None, 1), (4, [1.0, None], 2), (5, [nan], 2), (6, [inf] * 8, 2), (7, [-inf], None), (8, [], 3), (9, some(12), 3), (9, [], 3)]
    check_codes(spark, odd + odd + [(2, some(12), None)] * 3, "array<double>")
    check_codes(spark, [(i, some(8), i) for i in range(5)])
    check_codes(spark, [(i, [3000.0 * x for x in some(8)], i) for i in range(40)], "array<double>")  # beyond 16 bits
    far = spark.createDataFrame([(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1)], "vec_id long, embedding array<double>, label int")
    assert {r["error"] for r in vector_codes.compressed(far)[0].collect()} == {0}
    assert vector_codes.compressed(far.limit(0))[0].count() == 0
    assert vector_codes.compressed(far.selectExpr("vec_id", "CAST(NULL AS array<float>) AS embedding", "label"))[0].count() == 0


def test_labels_of_codes(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, [r.random() for _ in range(16)], r.choice((None, 0, 1))) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["vec_id"]: x for x in vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()}
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    want, books = searched(rows)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    for k, (i, _, label) in enumerate(rows):
        assert (got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) == (*want[k], digest)
        assert got[i]["label_error"] == sum(want[j][1] for j, x in enumerate(rows) if x[2] == label)


def test_bounds_are_outward_and_prune():
    r = np.random.default_rng(8)
    values = np.concatenate([r.uniform(0, 60000, 1000), [0, 1e-9, 65504, 1e9]])
    assert (vector_codes.up(values).astype(float) > values).all() and (vector_codes.down(values).astype(float) <= values).all()
    x = (r.normal(size=(2000, 8, 4)) * 300 + r.choice((-4000, 0, 4000), size=(2000, 8, 1))).astype(np.int64)
    books = vector_codes.Codebooks(x[:16].transpose(1, 0, 2).copy(), 1.0)
    state, took, full = books.first(x), 0, 0
    for _ in range(5):
        sums = books.sums(x, state[0])
        new = np.where(sums[..., -1:] > 0, sums[..., :-1] // np.maximum(sums[..., -1:], 1), books.entries)
        books = vector_codes.Codebooks(new, 1.0, books.entries)
        *state, n = books.next(x, *state)
        took, full = took + n, full + x.shape[0] * 8 * 16
        assert (state[0] == books.first(x)[0]).all()
        far = np.sqrt(vector_codes.squared(x[:, :, None], books.entries[None]))
        assert (state[2].astype(float) <= far).all() and (state[1].astype(float) >= far.min(axis=2)).all()
    assert took < full / 3


# -- pair index


def plain_merge(symbols, ranks):
    """The least rank, leftmost first, one merge at a time."""
    symbols = list(symbols)
    while found := [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        _, i = min(found)
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]
    return symbols


def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def test_index_against_the_library():
    r = random.Random(9)
    bpe, own = pair_index.PairIndexBPE(public_tokenizers.path("byte_bpe_50k.json")), library()
    texts = ["", " ", "a" * 20000, "ab" * 9000, "x" * 9000 + "y", " \n\t " * 90, "it's we'll I'M", "<|endoftext|>", " <|endoftext|>  a<|endoftext|><|endoftext", "<|endoftext|" * 3, "\x00\x1c\x85\xa0  ", "日本語テキスト" * 300, "é\U0001f600‍"]
    texts += ["".join(r.choice("ab ecdé\n'st") for _ in range(r.randint(1, 400))) for _ in range(300)]
    texts += ["".join(chr(r.choice((r.randrange(0x20, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x110000)))) for _ in range(900)) for _ in range(12)]
    texts.append("a" + "1".join(pair_index.newer_letters()[:300]) + "b")
    ids, ends = bpe.encode(texts)
    for i, want in enumerate(own.encode_batch(texts, add_special_tokens=False)):
        got = ids[ends[i] : ends[i + 1]]
        assert got.tolist() == want.ids, texts[i][:50]
        assert bpe.decode(got) == own.decode(want.ids, skip_special_tokens=False) == texts[i]


def vocabulary(folder, merges, **model):
    letters = pair_index.alphabet()
    tokens = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    tokens += dict.fromkeys(a + b for a, b in merges)
    file = {"version": "1.0", "truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    file["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges} | model
    path = folder / "vocabulary.json"
    path.write_text(json.dumps(file))
    return str(path)


@pytest.mark.parametrize("ordered", [True, False])
def test_index_with_any_order_of_merges(tmp_path, ordered):
    merges = [("a", "a"), ("aa", "a"), ("a", "b"), ("aa", "aa"), ("ab", "ab"), ("b", "a"), ("ab", "a"), ("aaa", "b"), ("c", "c"), ("cc", "c")]
    if not ordered:
        merges = merges[::-1]
    bpe = pair_index.PairIndexBPE(vocabulary(tmp_path, merges))
    assert bpe.merges.ordered == ordered
    ids = {t: i for i, t in enumerate(bpe.tokens)}
    ranks = {(ids[a.encode()], ids[b.encode()]): (r, ids[(a + b).encode()]) for r, (a, b) in enumerate(merges)}
    r = random.Random(10)
    pieces = ["".join(r.choice("aaabc") for _ in range(r.randint(1, 40))).encode() for _ in range(300)]
    got, size = bpe.merged(pieces)
    ends = np.cumsum(size)
    for piece, low, high in zip(pieces, ends - size, ends):
        assert got[low:high].tolist() == plain_merge([ids[bytes([b])] for b in piece], ranks)


def test_files_that_are_refused(tmp_path):
    for model in ({"unk_token": "x"}, {"dropout": 0.1}, {"byte_fallback": True}, {"continuing_subword_prefix": "##"}):
        with pytest.raises(ValueError, match="byte-level"):
            pair_index.PairIndexBPE(vocabulary(tmp_path, [("a", "b")], **model))
    with pytest.raises(ValueError, match="without a token"):
        pair_index.PairIndexBPE(vocabulary(tmp_path, [], vocab={"a": 0}))


def test_round_trip_of_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    path, own = pair_index.default_vocabulary(), library()
    rows = pair_index.round_trip(odd_docs, path).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    encoded = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert sorted((len(e), np.array(e, "<u4").tobytes(), t) for e, t in zip(encoded, texts)) == sorted((r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows)
    assert pair_index.round_trip(no_docs, path).count() == pair_index.digests(no_docs, path).count() == 0


def test_op13(spark, sf_dir):
    own, got = library(), {r["doc_id"]: r for r in pair_index.op13_pair_index_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode(r["text"], add_special_tokens=False).ids
        hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()
        assert tuple(got[r["doc_id"]])[1:] == (len(ids), hexed(",".join(map(str, ids))), hexed(own.decode(ids, skip_special_tokens=False)))


def test_windows_keep_rows_together():
    import pyarrow as pa

    column = [None, "abc", "", "x" * 50, "d"] * 7
    batches = [pa.record_batch([pa.array(range(k, k + 5)), pa.array(column[k : k + 5], pa.string())], ["id", "text"]) for k in range(0, 35, 5)]
    for chars in (1, 10, 60, 10**6):
        out = [(i, t) for ids, texts in pair_index.windows(iter(batches), chars) for i, t in zip(ids.to_pylist(), texts, strict=True)]
        assert out == [(k, t or "") for k, t in enumerate(column)]
    assert list(pair_index.windows(iter([]), 5)) == []
