"""Document fingerprints from spot signatures.

An anchor is a common word; its signature is the anchor with the chain of CHAIN content words (words that are no anchors)
that follow it. The set of a text's signature hashes is its fingerprint, written as base64 of sorted 32-bit numbers.
Likeness is the Jaccard coefficient of two sets, pruned by their sizes: sets whose sizes differ too much for the asked
threshold are never intersected.

``near_pairs`` joins a table with itself: texts are partitioned by set length, so only neighbouring length classes
can reach the threshold, candidates share one of their rarest signatures (prefix filter, exact) and a size-pruned
Jaccard decides. Texts with equal fingerprints meet once, as one representative.

Defined cases: a null text counts as empty and has the empty set; a text with words but no chain has one signature of all
its words; two empty sets have likeness 1, one empty set and another 0; the document order is doc_id descending, nulls
last, ties and repeated rows by text; with one row the next document is the row itself; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COMMON_WORDS, Grown, WordTable, mix64, partitions, staged, table

CHAIN = 2
THRESHOLD = 0.8

EDGES = b".,;:!?\"'()[]"


class SpotTable(WordTable):
    """Words with the hash of their plain form and their kind: content 0, anchor 1, no letters 2."""

    def __init__(self):
        super().__init__()
        self._kinds = Grown(np.int8)

    def __missing__(self, word: bytes) -> int:
        plain = word.lower().strip(EDGES)
        row = super().__missing__(word)
        self.hashes[row] = xxhash.xxh3_64_intdigest(plain)
        self.extra.append(2 if not plain else 1 if plain in COMMON_WORDS else 0)
        return row

    def trim(self) -> None:
        super().trim()
        if not self:
            self._kinds.reset()

    def kinds(self, rows: np.ndarray) -> np.ndarray:
        return self._kinds.of(self.extra)[rows]


def signatures(text: str, words: SpotTable) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text."""
    rows = words.rows(text.encode(errors="surrogatepass").split())
    if not len(rows):
        return np.empty(0, np.uint32)
    hashes, kinds = words.word_hashes(rows), words.kinds(rows)
    words.trim()
    content, anchors = np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 1)
    first = np.searchsorted(content, anchors)
    whole = first + CHAIN <= len(content)
    anchors, first = anchors[whole], first[whole]
    if not len(anchors):
        mixed = hashes * (mix64(np.arange(1, len(hashes) + 1, dtype=np.uint64)) | np.uint64(1))
        return np.array([int(mix64(mixed.sum(keepdims=True))[0]) >> 32], np.uint32)
    key = hashes[anchors]
    for step in range(CHAIN):
        key = mix64(key) + hashes[content[first + step]]
    return np.unique((mix64(key) >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without intersecting if the sizes rule out the threshold."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < threshold * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common)


def written(found: np.ndarray) -> str:
    """A set as text."""
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def _ordered_with_next(df: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, ahead), cut by doc_id into parts, sorted descending; each part ends with the row after it (ahead)."""
    from pyspark.ml.feature import Bucketizer

    count = 4 * partitions(df.sparkSession)
    ids = df.select(F.col("doc_id").cast("double").alias("id")).where("id IS NOT NULL")
    at = sorted(set(ids.approxQuantile("id", [i / count for i in range(1, count)], 1 / (8 * count)))) if count > 1 else []
    part = F.lit(0)
    if at:
        cut = Bucketizer(splits=[-float("inf"), *at, float("inf")], inputCol="__id", outputCol="__part", handleInvalid="keep")
        df = cut.transform(df.withColumn("__id", F.col("doc_id").cast("double")))
        part = F.col("__part").cast("int")
    coded = df.select(F.when(F.col("doc_id").isNull(), -1).otherwise(part).alias("part"), "doc_id", "text")
    firsts = sorted(coded.groupBy("part").agg(F.max("doc_id").alias("id")).collect(), key=lambda x: -x["part"])  # a row for each part
    if not firsts:
        return coded.select("*", F.lit(0).alias("ahead"))
    before = {x["part"]: firsts[i - 1]["part"] for i, x in enumerate(firsts)}
    top = coded.sparkSession.createDataFrame([(x["part"], before[x["part"]], x["id"]) for x in firsts], "p int, b int, id long")
    heads = coded.join(F.broadcast(top), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("id")))  # its size is the number of parts
    heads = heads.groupBy("b", "doc_id").agg(F.min("text").alias("text")).select(F.col("b").alias("part"), "doc_id", "text", F.lit(1).alias("ahead"))
    rows = coded.select("*", F.lit(0).alias("ahead")).unionByName(heads)
    return rows.repartition(count, "part").sortWithinPartitions(F.desc("part"), "ahead", F.col("doc_id").desc_nulls_last(), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, held, out = SpotTable(), None, []
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names) if out else pa.record_batch([pa.array([], t) for t in types], names)
        out.clear()
        return made

    for batch in batches:
        for part, doc_id, text, ahead in zip(*(c.to_pylist() for c in batch.columns)):
            own = signatures(text, words)
            if held is not None and held[0] == part:
                _, id_, old, found = held
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                changed = signatures(edited, words)
                digest = sha256(edited.encode()).hexdigest()
                out.append((id_, len(old), digest, written(found), written(changed), likeness(found, changed), likeness(found, own)))
            held = None if ahead else (part, doc_id, text, own)
            if len(out) >= 1000:
                yield flush()
    yield flush()


def fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text (its second half replaced from the next document), with likenesses."""
    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _ordered_with_next(plain).mapInArrow(_fingerprint_batches, OUT)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = SpotTable()
    for batch in batches:
        found = [signatures(x, words).astype(np.int64).tolist() for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sigs"])


def near_pairs(df: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has doc_id and rep, its class of equal fingerprints; pairs has a, b (representatives) and likeness."""
    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = staged(plain.mapInArrow(_set_batches, "doc_id long, sigs array<long>"), "spot-sets")
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes.select("*", F.monotonically_increasing_id().alias("c")), "spot-classes")  # written, so a class keeps its number
    members = sets.join(classes, "sigs").select("doc_id", "rep")
    reps = classes.select("c", "sigs", F.size("sigs").cast("long").alias("n")).where("n > 0")
    often = reps.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    ranked = reps.select("c", "n", F.explode("sigs").alias("sig")).join(often, "sig")
    place = F.row_number().over(Window.partitionBy("c").orderBy("count", "sig"))
    prefix = F.col("n") - F.ceil(F.round(threshold * F.col("n"), 9)) + 1
    heads = staged(ranked.select("c", "n", "sig", place.alias("place")).where(F.col("place") <= prefix).select("c", "n", "sig"), "spot-heads")
    # The length class of n is floor(log n / -log t); sets within the threshold are in the same or the next class.
    cls = F.floor(F.log("n") / -np.log(threshold)).cast("long")
    left = heads.select(F.col("c").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(cls - 1, cls, cls + 1)).alias("cls"))
    right = heads.select(F.col("c").alias("b"), F.col("n").alias("nb"), "sig", cls.alias("cls"))
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    maybe = left.join(right, ["sig", "cls"]).where(close).select("a", "b").distinct()
    full = classes.select("c", "sigs", "rep")
    both = maybe.join(full.toDF("a", "sa", "ra"), "a").join(full.toDF("b", "sb", "rb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    scored = both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), (common / (F.size("sa") + F.size("sb") - common)).alias("likeness"))
    return members, scored.where(F.col("likeness") >= threshold)


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses for every document."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
