"""Filter interaction audit: what each of five filters removes in every order they could be applied in.

A document is its failure mask, five bits, one for each filter. All that an order of filters does to a document follows from
its mask, so a part of the corpus is three histograms over the 32 masks: all documents, good ones and toxic ones. They
are stacked as rows of a matrix, which integer matrices of 32 rows and a column for each of the 600 (order, step) multiply: a cell
says whether a document of that mask is kept after the step, removed by it, removed earlier though it fails the
step's filter as well (redundant), or fails that filter only (unique).

Texts are read once, by Spark expressions. The copies of a text meet by its md5: only digests and ids are shuffled, and
of a group of copies with a third of all rows the aggregation leaves one row for each task.

Defined cases: a null text counts as empty, a null lang is the part ''; an empty text has no words and fails A only (and E, if a smaller id has
an empty text); rows of equal doc_id and text are no copies of each other; a null doc_id is neither smaller nor larger than any;
a document is good (toxic) if any label row of its id says so; an empty table has no parts and gives an empty result; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, staged, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
_SPACE = r"[\x20\x09-\x0D]+"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


@lru_cache(1)
def orders() -> list[str]:
    """All orders of the filters, ascending."""
    return ["".join(p) for p in permutations(FILTERS)]


@lru_cache(1)
def outcomes() -> dict[str, np.ndarray]:
    """Matrices with a row for each mask and a column for each (order, step); and shapley, with a column for each filter."""
    bit = np.array([[FILTERS.index(f) for f in order] for order in orders()])  # order, step
    fails = np.arange(1 << len(FILTERS))[:, None, None] >> bit & 1  # mask, order, step
    before = np.concatenate([np.zeros_like(fails[..., :1]), np.maximum.accumulate(fails, axis=2)[..., :-1]], axis=2)
    wide = lambda x: np.ascontiguousarray(x.reshape(len(fails), -1), np.int64)
    removed = wide(fails & (1 - before))
    only = np.arange(1 << len(FILTERS))[:, None, None] == 1 << bit
    filters = bit.ravel()[:, None] == np.arange(len(FILTERS))
    return {"kept": wide((1 - fails) & (1 - before)), "removed": removed, "redundant": wide(fails & before), "unique_fails": wide(only), "shapley": removed @ filters.astype(np.int64), "filter": bit.ravel()}


def multiplied(histograms: np.ndarray) -> np.ndarray:
    """int64[part, order and step, count] for int64[part, (all, good, toxic), mask]."""
    m = outcomes()
    every, good, toxic = (np.ascontiguousarray(histograms[:, k]) for k in range(3))
    columns = [every @ m["kept"], every @ m["removed"], every @ m["redundant"], every @ m["unique_fails"], good @ m["removed"], toxic @ m["removed"], (every @ m["shapley"])[:, m["filter"]]]
    return np.stack(columns, axis=2)


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array([o for o in orders() for _ in FILTERS])
    steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders())))
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            stacked = np.zeros((1, 3, 1 << len(FILTERS)), np.int64)
            for cell in cells:
                stacked[0, :, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            counts = multiplied(stacked)[0]
            columns = [pa.array([part] * len(names), pa.string()), names, steps, *(pa.array(c) for c in counts.T)]
            yield pa.record_batch(columns, ["part", "filter_order", "step", *COUNTS])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) for every row; mask has the bits of A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    n, upper = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.md5("text")).alias("digest"))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row; mask has the bits of all filters."""
    rows = staged(failures(docs), "audit-failures")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")).where("count > 1")
    groups = staged(groups, "audit-copies")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    out = lookup(rows, groups.select("digest", "least"), "digest", groups, how="left")
    return out.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): one row for each mask that occurs in a part."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    marks = marks.where("doc_id IS NOT NULL AND quality + toxic > 0").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    rows = masked(docs).join(marks, "doc_id", "left")
    some = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), some("good"), some("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step. docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    parts = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return parts.mapInArrow(_audit_batches, AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over every part of the documents."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
failed AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * upper > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM counted),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT filter_order, k::INT AS step, filter_order[k] AS f FROM orders, range(1, 6) t(k)),
seen AS (
  SELECT part, filter_order, step, f, n, good, toxic, (CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails,
    a::INT + b::INT + c::INT + d::INT + e::INT AS failures,
    least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END, CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END,
      CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END, CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS first
  FROM cells, steps),
counts AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND first < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts
"""
