import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import classifier, common, mixing, near_dedup, quality_rules, url_filter


def counts_by_hand(text):
    words = (text or "").encode().split()
    seen, marked = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    lines, earlier, again = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            again += x in earlier
            earlier.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(marked)


def test_counts(spark, odd_docs, no_docs):
    r = random.Random(4)
    for t in [x["text"] for x in odd_docs.collect()] + ["\n".join(" ".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(8)) for _ in range(60)]:
        assert quality_rules.count_text(None if t is None else t.encode())[:5] == counts_by_hand(t)
    assert quality_rules.judged(odd_docs).count() == odd_docs.count() and quality_rules.judged(no_docs).count() == 0
    assert quality_rules.keep_good(no_docs).count() == 0 and quality_rules.keep_good(odd_docs).columns == odd_docs.columns


def test_weak_supervision_recovers_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((20_000, 5), int)
    for k, (hit, false) in enumerate([(0.9, 0.02), (0.6, 0.01), (0.5, 0.05), (0.7, 0.02), (0.3, 0.01)]):
        bad_vote = np.where(good, rng.random(20_000) < false, rng.random(20_000) < hit)
        votes[:, k] = np.where(rng.random(20_000) < 0.1, 0, np.where(bad_vote, -1, 1))
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality_rules.expectation_maximisation(patterns, weights.astype(float))
    assert prior == pytest.approx(0.8, abs=0.02) and table[0, 0, 0] == pytest.approx(0.81, abs=0.03) and table[1, 3, 0] == pytest.approx(0.018, abs=0.01)
    assert quality_rules.expectation_maximisation(np.empty((0, 5)), np.empty(0))[0] == 0.8


def test_rules_and_classifier_find_the_junk(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ruled = quality_rules.op9_quality_rules(spark, sf_dir).collect()
    assert sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in ruled) >= 0.95 * len(ruled)
    scored = classifier.op3_quality_classifier(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in scored)
    held = [(r["score"], labels[r["doc_id"]]) for r in scored if r["held_out"]]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x > y]
    assert sum(pairs) / len(pairs) > 0.9
    assert [tuple(r) for r in scored] == [tuple(r) for r in classifier.op3_quality_classifier(spark, sf_dir).collect()]


def test_posterior_by_hand(spark, sf_dir):
    """Votes are counted, the model fitted and every posterior multiplied out from the vote tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ballots = quality_rules.judged(docs.select("doc_id", "text")).select("row.doc_id", "votes", "posterior", "base_failed", "kept", "c.n_words", "c.n_repeat_words").collect()
    seen = Counter(tuple(r["votes"]) for r in ballots)
    prior, table = quality_rules.expectation_maximisation(np.array(sorted(seen)), np.array([float(seen[v]) for v in sorted(seen)]))
    for r in ballots:
        good, bad = prior, 1 - prior
        for k, v in enumerate(r["votes"]):
            good, bad = good * table[1, k, v + 1], bad * table[0, k, v + 1]
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["posterior"] == pytest.approx(good / (good + bad), abs=1e-9)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_short_clean_texts_stay(spark):
    rows = [(1, "A short clean note."), (2, "spam " * 40), (3, "$$$ ### *** " * 3), (4, "the cat sat on the mat and it was glad of that.")]
    kept = quality_rules.keep_good(spark.createDataFrame(rows * 5, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {1, 4}


def features_by_hand(text):
    """Every bucket of a text, one entry for each occurrence."""
    out, words = [], text.encode().split()
    for w in words:
        marked = f"<{w.decode()}>"
        out += [zlib.crc32(w) % classifier.BUCKETS] + [zlib.crc32(marked[i : i + n].encode(), 1) % classifier.BUCKETS for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    hashed = [xxhash.xxh3_64_intdigest(w) for w in words]
    mix = lambda x: int(classifier.mix64(np.array([x], np.uint64))[0])
    hashed = [mix(h) for h in hashed]
    for a, b in zip(hashed, hashed[1:]):
        out.append(mix((a * 0x9E3779B97F4A7C15 + b) % 2**64) % classifier.BUCKETS)
        out += [classifier.SAME] * (a == b)
    return out


def test_scores_by_hand(spark):
    """Averages of vectors through the softmax layer, feature by feature, against the summed logits of the operator."""
    texts = ["good plain words here", "bad bad bad spam", "né à la côte", "spam spam good", "one"]
    examples = []
    for i, t in enumerate(texts):
        buckets, times = np.unique(features_by_hand(t), return_counts=True)
        found, counts = classifier.document_buckets(t.encode(), classifier.BucketTable())
        assert found.tolist() == buckets.tolist() and counts.tolist() == times.tolist()
        examples.append((buckets, times, i % 2))
    logits = classifier.train(examples)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", classifier.score_column(spark, logits, F.col("text").cast("binary")).alias("s")).collect()}
    for i, t in enumerate(texts):
        z = np.mean([logits[b] for b in features_by_hand(t)])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(4))


def test_odd_classifier_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert classifier.keep_good(odd_docs, odd_docs, labels).columns == odd_docs.columns
    logits = classifier.fit(odd_docs, labels.limit(0))
    scores = odd_docs.select(classifier.score_column(spark, logits, F.col("text").cast("binary")).alias("s")).collect()
    assert {r["s"] for r in scores} == {0.5}
    assert classifier.keep_good(no_docs, no_docs, labels).count() == 0


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_its_targets(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(9).withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.lit(None).cast("string")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op7_mixing(spark, str(tmp_path)).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert target == pytest.approx(targets_by_hand(sizes))
    biggest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= biggest / 2 for s in sizes) and sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    copies = Counter(r["row"]["doc_id"] for r in mixing.mix(docs, shards=4).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows)
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) == copies


def test_splitting_tree_is_exact_and_hypergeometric():
    quota = np.array([7, 0, 100, 33])
    out = mixing.split_quotas(quota, 5, seed=3)
    assert (out.sum(axis=1) == quota).all() and out.sum(axis=0).max() - out.sum(axis=0).min() <= 2
    first = np.array([mixing.split_quotas(np.array([30, 70]), 2, seed=s)[0, 0] for s in range(2000)])
    assert first.mean() == pytest.approx(15, abs=0.3) and first.var() == pytest.approx(50 * 0.3 * 0.7 * 50 / 99, rel=0.15)


def test_more_sources_than_groups(spark, monkeypatch):
    """Sources share the groups of the tree; every target is met as before and every shard gets its share of blocks."""
    monkeypatch.setattr(mixing, "GROUPS", 3)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "concat('s', id % 2500) AS source")
    rows = mixing.dealt(docs.select(F.struct("doc_id", F.col("source").alias("s")).alias("row"), "source", mixing.word_count(F.col("text")).alias("size"), mixing.unit_hash(mixing.SEED, F.col("doc_id")).alias("u")), 8).select("row.s", "size", "target", "draws").collect()
    sizes, taken, target, shards = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r["s"]] += r["size"]
        taken[r["s"]] += r["size"] * len(r["draws"])
        target[r["s"]] = r["target"]
        shards.update(d["shard"] for d in r["draws"])
    assert len(sizes) == 2500 and target == pytest.approx(targets_by_hand(sizes)) and all(abs(taken[s] - target[s]) <= 3.5 for s in sizes)
    assert set(shards) == set(range(8)) and max(shards.values()) < 1.25 * min(shards.values())


def test_a_large_edge_block(spark, monkeypatch):
    """The edge block of a source is cut twice: with two blocks a level the cut still falls at the target."""
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 2)
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    rows = mixing.dealt(docs.select(F.struct("doc_id", F.col("source").alias("s")).alias("row"), "source", mixing.word_count(F.col("text")).alias("size"), mixing.unit_hash(mixing.SEED, F.col("doc_id")).alias("u")), 2)
    told = rows.groupBy("row.s", "target").agg(F.sum(F.col("size") * F.size("draws")).alias("taken")).collect()
    assert len(told) == 2 and all(abs(r["taken"] - r["target"]) <= 4.5 for r in told)


def test_a_hot_source_among_many(spark):
    """20,000 sources, one of which (null) holds half of all documents: no task gets its rows together, and each source meets its target."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 80_000, 1, 16).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 1 THEN concat('s', id % 40000) END AS source", "1 + id % 5 AS size")
        rows = docs.select(F.struct("doc_id").alias("row"), "source", "size", mixing.unit_hash(mixing.SEED, F.col("doc_id")).alias("u"))
        out = mixing.dealt(rows)
        tasks = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 80_000 and max(tasks) <= 80_000 * 16 / 64
        told = out.join(docs.select("doc_id", "source"), F.col("row.doc_id") == F.col("doc_id")).groupBy("source", "target").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"), F.sum("size").alias("size"))
        assert told.where(F.abs(F.col("taken") - F.col("target")) > 5).count() == 0 and told.count() == 20_001
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_odd_mix(spark, odd_docs, no_docs, tmp_path):
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(no_docs).count() == 0
    for name, df in (("odd", odd_docs), ("none", no_docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert mixing.op7_mixing(spark, f"{tmp_path}/{name}").count() == df.count()


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(5)
    for _ in range(1500):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 25))]
        b = list(a) if r.random() < 0.6 else [r.randint(0, 4) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randint(0, 4)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        most, want = r.randint(0, 12), distance_by_hand(a, b)
        got = near_dedup.banded_distance(a, b, most)
        assert got == want if want <= most else got > most


def test_bounds_decide_as_the_alignment_does():
    r = random.Random(13)
    for _ in range(1500):
        a = [r.randint(0, 9) for _ in range(r.randint(0, 40))]
        b = list(a) if r.random() < 0.8 else [r.randint(0, 9) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 10)):
            way, at = r.random(), r.randrange(len(b) + 1)
            if way < 0.4 and at < len(b):
                b[at] = r.randint(0, 9)
            elif way < 0.7:
                b.insert(at, r.randint(0, 9))
            elif b:
                b.pop(at % len(b))
        want = distance_by_hand(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near_dedup.similar(a, b, near_dedup.pairs_of(a)) == want
        assert near_dedup.greedy_cost(a, b, 99) >= distance_by_hand(a, b)


def test_candidates_side_by_side():
    """Bounds and alignments in whole arrays say what the plain comparison says, for few and for many candidates, of any length."""
    r = random.Random(17)
    for n, count in [(n, c) for n in (0, 1, 2, 5, 17, 60, 130) for c in (3, 40)]:
        a = [r.randrange(max(n, 1)) for _ in range(n)]
        others = []
        for _ in range(count):
            b = list(a)
            for _ in range(r.randint(0, max(3, n // 2))):
                way, at = r.random(), r.randrange(len(b) + 1)
                if way < 0.4 and at < len(b):
                    b[at] = r.randrange(n + 3)
                elif way < 0.7:
                    b.insert(at, r.randrange(n + 3))
                elif b:
                    b.pop(at % len(b))
            others.append(b if r.random() < 0.9 else [r.randrange(n + 3) for _ in range(r.randint(0, 2 * n + 2))])
        want = [near_dedup.similar(a, b, near_dedup.pairs_of(a)) for b in others]
        words = [np.array(x, np.uint64) for x in (a, *others)]
        assert near_dedup.aligned([(words[0], b) for b in words[1:]]).tolist() == want
        swapped = [(b, words[0]) if i % 2 else (words[0], b) for i, b in enumerate(words[1:])]  # each pair has texts of its own
        assert near_dedup.aligned(swapped + swapped[::-1]).tolist() == want + want[::-1]
        told = [near_dedup.bounded(words[0], b, near_dedup.pair_hashes(words[0])) for b in words[1:]]
        assert all(x is None or x == y for x, y in zip(told, want)) and (n < 17 or count < 40 or None in told)


def test_hashed_words():
    texts = [b"", b" \n", b"x" * 3_000_000 + b" y y " + b"z" * (1 << 20) + b" " + b"z" * (1 << 20), b"\x0b\x0ca\x1cb\x85 c", b"b a", b"a b y"]
    got = common.hashed_words(texts)
    seen = {}
    for text, hashes in zip(texts, got):
        words = text.split()
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) and common.hashed_words([]) == []


def classes_by_hand(rows):
    words = {i: (t or "").encode().split() for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(rows), 2):
        if near_dedup.similar(words[a], words[b], near_dedup.pairs_of(words[a])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in rows}


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = classes_by_hand({r["doc_id"]: r["text"] for r in docs.collect()})
    got = near_dedup.op8_order_minhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(set(want.values())) < len(want)
    assert {r["doc_id"] for r in near_dedup.keep_one(docs).collect()} == set(want.values())


def test_large_groups_and_shared_passages(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.01 else word() for w in base)) for i in range(150)]
    rows += [(1000 + i, " ".join([word() for _ in range(80)] + passage + [word() for _ in range(80)])) for i in range(150)]
    rows += [(2000 + i, "the same text again and again") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, classes = near_dedup.classified(docs)
    got = {x["doc_id"]: x["class_id"] for x in sets.join(classes, "digest").collect()}
    assert {got[i] for i in range(150)} == {0} and {got[2000 + i] for i in range(50)} == {2000}
    assert all(got[1000 + i] == 1000 + i for i in range(150))


def test_pairs_at_the_threshold_share_a_key():
    """Words replaced at random or evenly spaced, at 5 to 20 %; 0.97 leaves room for the draw of 200 pairs."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (5, 10, 15, 20, 25, 50, 200, 1000):
        for rate in (0.05, 0.1, 0.15, 0.2):
            edits = int(rate * n + 1e-9)
            for way in ("random", "even"):
                old = [draw(n) for _ in range(200)]
                new = [a.copy() for a in old]
                for b in new:
                    b[rng.choice(n, edits, replace=False) if way == "random" else ((np.arange(edits) + 0.5) * n // max(1, edits)).astype(int)] = draw(edits)
                found = sum(np.intersect1d(a, b).size > 0 for a, b in zip(near_dedup.keys_of(old), near_dedup.keys_of(new)))
                assert found >= 0.97 * 200, (n, rate, way, found)


def test_sketches_of_texts_over_a_million_words():
    """A word more at the front moves every place; the keys stay, and the texts beside the long one keep theirs."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    base, small = draw(1 << 21), draw(300)
    copy = np.concatenate([draw(1), base])
    copy[rng.choice(len(copy), 20_000, replace=False)] = draw(20_000)
    a, b, c = near_dedup.sketches([base, small, copy], 24)
    assert (a == c).sum() >= 20 and (b == near_dedup.sketches([small], 24)[0]).all()


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """400 copies with 12 to 15 % of the words edited: most reach 0.8 with the original only, which is rarely first or last of a bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # many blocks
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [list(base)]
    for _ in range(400):
        copy = list(base)
        for at in r.sample(range(200), r.randint(24, 30)):
            copy[at] = word()
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sketched = docs.select("doc_id", near_dedup.digest_of(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("text"))
    keys = {x["doc_id"]: set(x["keys"]) for x in sketched.mapInArrow(near_dedup._sketch_batches, "doc_id long, digest binary, keys array<long>").collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if keys[a] & keys[b] and near_dedup.similar(texts[a], texts[b], near_dedup.pairs_of(texts[a])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    sets, classes = near_dedup.classified(docs)
    got = {x["doc_id"]: x["class_id"] for x in sets.join(classes, "digest").collect()}
    assert got == {i: find(i) for i in range(len(texts))} and Counter(got.values())[0] > 350


def test_odd_near_duplicates(spark, odd_docs, no_docs):
    kept = near_dedup.keep_one(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "3", "4", "4", "5", "6", "7", "8", "None"]  # 0, 1 and 2 have no words
    assert near_dedup.keep_one(no_docs).count() == 0 and near_dedup.keep_one(odd_docs).columns == odd_docs.columns
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_dedup.keep_one(nameless).collect()) == ["a b", "c"]


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and got[101] == 100


def verdict_by_hand(url):
    url = url or ""
    rest = url.partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in url_filter.op10_url_filter(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for i, url in pages.items():
        host, path, rule, verdict = verdict_by_hand(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")


def test_model_probabilities_by_hand(spark):
    urls = [("a.com/xyz", 3, 0), ("b.net/es/q", 0, 2), ("ab", 1, 1)]
    cut = lambda s: [(url_filter.PAD * 4 + s + url_filter.STOP)[i : i + 5] for i in range(len(s) + 1)]
    counts = defaultdict(lambda: [0, 0])
    for s, a, r in urls:
        for w in cut(s):
            counts[w][0] += a
            counts[w][1] += r

    def p(w, side):
        out = 1 / url_filter.ALPHABET
        for k in range(5):
            gram, context = w[4 - k :], w[4 - k : 4]
            n = sum(c[side] for x, c in counts.items() if x.endswith(gram))
            m = sum(c[side] for x, c in counts.items() if x[4 - k : 4] == context)
            out = (n + url_filter.PRIOR * out) / (m + url_filter.PRIOR)
        return out

    wanted = sorted({w for s in ("a.com/x", "zz", "b.net/es/") for w in cut(s)})
    table = spark.createDataFrame([(w, *c) for w, c in counts.items()], "window string, a long, r long")
    got = {r["window"]: r["ratio"] for r in url_filter.window_ratios(table, spark.createDataFrame([(w,) for w in wanted], "window string")).collect()}
    assert got == {w: pytest.approx(np.log(p(w, 0) / p(w, 1)) * 1e6, abs=1) for w in wanted}


def test_query_strings_and_urls_without_a_scheme_count(spark):
    """Only what follows the path, or the whole text of a URL without a scheme, tells these apart."""
    good, bad = [f"h://a{i}.com/?{'note' * 3}{i}" for i in range(60)], [f"h://b{i}.net/es/?{'spam' * 3}{i}" for i in range(60)]
    rows = list(enumerate(good + bad + ["h://z.org/p?notenote", "h://z.org/p?spamspam", "notenotenote", "spamspamspam"]))
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select("row.page_id", "verdict").collect()
    assert [r["verdict"] for r in sorted(out, key=lambda r: r["page_id"])[-4:]] == ["allow", "block", "allow", "block"]


def test_odd_urls(spark):
    rows = [(1, None), (1, None), (2, "no scheme"), (3, "x://"), (4, "://a.com/"), (None, "h://[é😀]/" + "p" * 3000), (5, "h://com"), (6, "h://com/"), (7, "h://a\nb.com/x://y")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "'z' AS label")
    out = url_filter.judge(df).select("row.page_id", "row.host", F.col("rule"), F.col("verdict")).collect()
    assert len(out) == len(rows) and all(r["verdict"] in ("allow", "block") for r in out) and {r["rule"] for r in out if r["page_id"] in (4, 6, 7)} == {"com/"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_the_driver_gets_few_bytes_for_the_sample(spark, tmp_path, monkeypatch):
    """Two bytes for a bucket and as few as its text needs for a count; the model is that of the same examples in whole numbers."""
    r, words = random.Random(3), "the of and hello world again *** prose junk".split()
    texts = [" ".join(r.choice(words) + r.choice("abcdefgh") for _ in range(r.randint(1, 300))) for _ in range(60)] + ["the " * 300, "a " * 70_000, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    examples = []
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5:
            examples.append((*classifier.document_buckets((t or "").encode(), classifier.BucketTable()), i % 2))
    got, real = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: got.append(x := real(self)) or x)
    logits = classifier.fit(docs, labels)
    assert (logits == classifier.train(examples)).all() and max(int(t.max(initial=0)) for _, t, _ in examples) > 65_535
    assert sum(x.nbytes for x in got) < 4 * sum(len(b) for b, _, _ in examples) + 100 * len(texts)


def test_a_lookup_leaves_out_what_it_does_not_need(spark, capsys):
    """Without hot keys no broadcast, with hot keys alone no shuffle; rows are those of a plain join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for n, keys, how, whole, absent in ((4000, 4000, "inner", False, "Broadcast"), (4000, 4000, "left", False, "Broadcast"), (4000, 3, "inner", True, "SortMergeJoin"), (4000, 3, "left", True, ""), (4000, 3, "inner", False, ""), (0, 1, "inner", True, "Broadcast")):
            rows = spark.range(n).select(F.when(F.col("id") % (1000 if keys > 3 else 10) != 7, F.col("id") % keys).alias("k"), "id")
            counts = common.staged(rows.groupBy("k").count(), "counts")
            found = counts.where("k != 1").select("k", (F.col("k") * 2).alias("v"))
            out = common.lookup(rows, found, "k", counts, how, whole=whole)
            want = rows.join(found, "k", how)
            assert out.columns == want.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, want.collect()))
            capsys.readouterr()
            out.explain()
            assert not absent or absent not in capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_of_a_word_table_are_no_objects():
    """Its arrays and sums follow the words, also after it started anew; a word holds 24 bytes in them."""
    logits = np.random.default_rng(2).normal(size=classifier.BUCKETS)
    words = classifier.LogitTable(logits)
    words.limit = 50
    for n in (0, 1, 40, 60, 30):
        some = [b"w%d" % (i * i % 71) for i in range(n)]
        rows = words.rows(some)
        assert words.word_hashes(rows).tolist() == [int(common.mix64(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))[0]) for w in some]
        if n:
            assert words.totals(rows) == pytest.approx([sum(logits[b] for w in some for b in classifier.word_buckets(w)), sum(len(classifier.word_buckets(w)) for w in some)])
        assert len(words) == 0 or (words.hashes.itemsize * len(words.hashes) + words.extra.itemsize * len(words.extra)) == 24 * len(words)
        words.trim()


def test_few_texts_are_python_objects_at_once():
    """A batch of 24 MB goes through rules and buckets in parts: counts are those of each text, and temporaries stay far below the batch."""
    texts = [None, ""] + [f"word{i % 7} of the " * 400 for i in range(4000)]
    batch = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    next(quality_rules._count_batches(iter([batch[:10]])))
    tracemalloc.start()
    (got,) = quality_rules._count_batches(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < batch.nbytes / 2 and len(got) == len(texts)
    assert [tuple(got[i].as_py().values()) for i in (0, 1, 2, 3999)] == [quality_rules.count_text((texts[i] or "").encode()) for i in (0, 1, 2, 3999)]
    found = next(classifier._bucket_batches(iter([batch[:20]]))).to_pylist()
    assert [(x["bucket"], x["times"]) for x in found] == [classifier.packed(*classifier.document_buckets((t or "").encode(), classifier.BucketTable())) for t in texts[:20]]


def test_buckets_of_words_take_two_bytes():
    words = classifier.BucketTable()
    some = [b"word", "d\u00e9j\u00e0".encode(), b"a", b"word"]
    buckets, n = words.grams(words.rows(some))
    want = [classifier.word_buckets(w) for w in some]
    assert n.tolist() == [len(x) for x in want] and buckets.tolist() == sum(want, [])
    assert sum(map(len, words.extra)) == 2 * sum(map(len, want[:3]))


def test_stages_send_small_batches_to_python(spark, odd_docs, monkeypatch):
    """What the rules and the classifier run in Python goes there in at most BATCH_ROWS rows; the session's own number comes back."""
    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], common.staged
    before = spark.conf.get(key)
    for module in (quality_rules, classifier):
        monkeypatch.setattr(module, "staged", lambda df, name: seen.append((name, int(spark.conf.get(key)))) or real(df, name))
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.keep_good(odd_docs).columns == classifier.keep_good(odd_docs, odd_docs, labels).columns == odd_docs.columns
    assert [n for n, _ in seen] == ["quality-rows", "quality-kept"] and all(rows == common.BATCH_ROWS for _, rows in seen)
    assert spark.conf.get(key) == before
