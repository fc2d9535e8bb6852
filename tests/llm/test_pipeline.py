import base64
import hashlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from tallyforge.llm import mixing, near_dedup, registry
from tallyforge.llm.common import staged


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ruled, scored, single, mixed, tokens = seen[1:]
    assert seen[0] > ruled >= scored > single and mixed == tokens
    whole = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: Counter((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert digest(whole) == digest(docs)


def first_of_classes(texts: dict) -> set:
    """The least id of each class of texts that are linked by a similarity of 0.8, from all pairs."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = {i: t.split() for i, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        if near_dedup.similar(words[a], words[b], near_dedup.pairs_of(words[a])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in texts}


def test_the_end_of_the_pipeline_by_other_means(spark, sf_dir):
    """What rules and classifier keep goes on through all pairs, DuckDB and tiktoken; the pipeline has to give the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in rows for i in good) >= 0.97 * len(good) and not any(i in rows for i, q in labels.items() if not q)
    kept = sorted(first_of_classes({i: r["text"] for i, r in rows.items()}))
    con = duckdb.connect()
    documents = docs.toPandas().query("doc_id in @kept")
    con.register("documents", documents)
    taken = {i: n // size if size else 0 for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP7_SQL})").fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i in kept:
        ids = encoding.encode_ordinary(rows[i]["text"])
        digest = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[i]["text"].encode()).hexdigest())
        want[digest] += taken[i]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want


def test_every_operator_is_registered():
    names = sorted(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_odd_rows_pass_as_a_whole(spark, odd_docs, tmp_path):
    """Null and repeated ids, null, empty and very long texts, clashing columns; then no rows at all."""
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in docs.collect()} and (name == "odd" or not ids)
