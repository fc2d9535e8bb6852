"""Quality classifier with supervised subword embeddings, trained by numpy stochastic gradient descent.

A word, each of its character n-grams (with word marks ``<`` and ``>``), each pair of adjacent words and each immediate
repetition of a word (one shared feature) is hashed into one of BUCKETS rows of an embedding table; a document is the average of its rows, followed by a softmax layer. The output
layer is linear, so after training each bucket is reduced to one number, its logit difference; scoring sums those, which
gives the same result as averaging vectors.

Training takes at most SAMPLE labelled rows of each class (those with the smallest hash of doc_id); their sparse bucket
counts, at most BUCKETS each, come to the driver, in two bytes for a bucket and one for a count if it fits, and are not copied there.
Scoring covers all rows and whole texts. The model has a fixed size and is broadcast.

Defined cases: a null text counts as empty; an empty text has the average vector 0 and so the score 0.5; labels that are
null teach nothing, and a document with several labels has the highest; repeated rows are scored alike; without labels
every score is 0.5; an empty table gives an empty result; in ``keep_good`` all columns pass through.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, in_parts, mix64, small_batches, staged, table

BUCKETS, DIM = 1 << 16, 16
MIN_N, MAX_N = 3, 5
SAMPLE = 2_000
EPOCHS, RATE, SEED = 8, 0.5, 7
FOLDS = 5
KEEP_AT = 0.3

MASK = BUCKETS - 1
SAME = zlib.crc32(b"<same>") & MASK


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = b"<%b>" % word
    if word.isascii():
        grams = [marked[i : i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(marked) - n + 1)]
    else:
        text = marked.decode(errors="replace")
        grams = [text[i : i + n].encode() for n in range(MIN_N, MAX_N + 1) for i in range(len(text) - n + 1)]
    return [zlib.crc32(word) & MASK, *[zlib.crc32(g, 1) & MASK for g in grams]]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of adjacent words, and SAME once for each word that repeats the one before it."""
    pairs = (mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) & np.uint64(MASK)).astype(np.int64)
    same = int(np.count_nonzero(hashes[:-1] == hashes[1:]))
    return np.concatenate([pairs, np.full(same, SAME, np.int64)]) if same else pairs


class BucketTable(WordTable):
    """Words with their buckets, two bytes each."""

    def added(self, word: bytes) -> None:
        self.extra.append(array("H", word_buckets(word)).tobytes())

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the buckets of rows, one row after the other; how many each row has)."""
        each = [self.extra[r] for r in rows]
        return np.frombuffer(b"".join(each), np.uint16), np.fromiter(map(len, each), np.int64, len(each)) // 2


class LogitTable(WordTable):
    """Words with the summed logits of their buckets and how many those are."""

    def __init__(self, logits: np.ndarray):
        super().__init__()
        self.logits = logits.tolist()

    def fresh(self) -> array:
        return array("d")

    def added(self, word: bytes) -> None:
        buckets = word_buckets(word)
        self.extra.extend((sum(map(self.logits.__getitem__, buckets)), len(buckets)))

    def totals(self, rows: np.ndarray) -> np.ndarray:
        """(sum of logits, n) over rows."""
        return np.frombuffer(self.extra).reshape(-1, 2)[rows].sum(axis=0)


def document_buckets(text: bytes | None, words: BucketTable) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, counts) of a whole text."""
    rows = words.rows((text or b"").split())
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    times = np.bincount(rows, minlength=len(words.extra))
    counts = np.bincount(pair_buckets(words.word_hashes(rows)), minlength=BUCKETS)
    used = np.flatnonzero(times)
    grams, n = words.grams(used)
    counts = counts + np.bincount(grams, np.repeat(times[used], n), minlength=BUCKETS).astype(np.int64)
    found = np.flatnonzero(counts)
    words.trim()
    return found, counts[found]


def _bucket_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    words = BucketTable(100_000)
    for batch in texts:
        found = [packed(*document_buckets(x, words)) for _, some in in_parts(batch) for x in some]
        yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["bucket", "times"])


def packed(buckets: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets in two bytes each, their counts in as few as hold the largest."""
    return buckets.astype("<u2").tobytes(), times.astype(np.min_scalar_type(int(times.max(initial=0)))).tobytes()


def unpacked(buckets: pa.Buffer, times: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """What packed got, read where it lies."""
    b = np.frombuffer(buckets, "<u2")
    return b, np.frombuffer(times, f"<u{len(times) // max(1, len(b)) or 1}")


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Logit difference (class 1 less class 0) of each bucket."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((DIM, 2), np.float32)
    known = [x for x in examples if len(x[0])]
    steps, done = max(1, EPOCHS * len(known)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(known)):
            buckets, times, y = known[i]
            share = (times / times.sum()).astype(np.float32)
            rate = np.float32(RATE * (1 - done / steps))
            mean = share @ vectors[buckets]
            z = mean @ output
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y] -= 1
            back = output @ error
            output -= rate * np.outer(mean, error)
            vectors[buckets] -= (rate * share)[:, None] * back[None, :] * len(buckets) ** 0.5
            done += 1
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Train on a bounded sample of the labelled rows outside fold 0."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("y = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("y = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * SAMPLE ids
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    counted = texts.select("doc_id", "y", F.arrow_udf(_bucket_batches, "bucket binary, times binary")("text").alias("b"))
    with small_batches(docs.sparkSession):
        got = counted.select("doc_id", "y", "b.bucket", "b.times").toArrow()
    rows = [x for batch in got.to_batches() for x in zip(*(batch.column(c) for c in ("doc_id", "y", "bucket", "times")))]
    rows.sort(key=lambda x: x[0].as_py())
    logits = train([(*unpacked(b.as_buffer(), t.as_buffer()), int(y.as_py())) for _, y, b, t in rows])
    del got, rows
    pa.default_memory_pool().release_unused()
    return logits


def score_column(spark: SparkSession, logits: np.ndarray, text: Column) -> Column:
    """The probability of class 1 for a binary text column."""
    model = spark.sparkContext.broadcast(logits)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, pairs = LogitTable(model.value), model.value
        for batch in texts:
            out = np.zeros(len(batch))
            for low, some in in_parts(batch):
                for i, text in enumerate(some, low):
                    rows = words.rows(text.split())
                    if len(rows):
                        total, n = words.totals(rows)
                        near = pair_buckets(words.word_hashes(rows))
                        out[i] = (total + pairs[near].sum()) / (n + len(near))
                        words.trim()
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return F.arrow_udf(score, "double")(text)


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is at least KEEP_AT, with all their columns; learns from the texts of labelled. Staged."""
    score = score_column(docs.sparkSession, fit(labelled, labels), F.col("text").cast("binary"))
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    with small_batches(docs.sparkSession):
        return staged(docs.select(row, score.alias("score")).where(F.col("score") >= KEEP_AT), "quality-kept").select("row.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    logits = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(spark, logits, F.col("text").cast("binary")).alias("score"))
    return scored.select("*", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
