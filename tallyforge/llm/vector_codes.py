"""Vector codes: each vector is cut into equal parts, each part is replaced by the index of the nearest entry of its codebook.

Codebooks come from Lloyd rounds by Elkan's method. For each part of each vector a row keeps its entry, an upper bound of the distance to it and one
lower bound of the distance to every entry. When entries move, upper bounds grow and lower bounds shrink by the movement; an
entry is left out without looking at the vector if its lower bound, or half its distance from the present entry, is strictly
above the upper bound. What is left is compared by exact squared integer distances, ties to the lower index, so the codes are
those of a full search. Bounds are 16-bit floats, always rounded outward, in a unit (a power of two) that fits the data.

State is written to the shared folder once a round; the table of the round before goes when the next is complete. A task
also writes one row with its sums, so a round reads the vectors once; the sums of all tasks are added up by Spark, and the
driver sees the codebooks only, 16 entries of the vectors' own length.

Defined cases: rows whose vector is null, or holds a null or non-finite component, are dropped; vectors shorter than the longest
(rounded up to a multiple of the parts) count as ending in zeros; the first entries go by vec_id (null last), then by the vector; with fewer vectors than entries the codebooks are
smaller; scaled components beyond +-LIMIT, under which squared distances fit 63 bits, count as the limit; repeated rows are coded alike; null labels are one label; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lookup, removed, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BATCH = 4096
_SURE = 1 + 1e-12  # room for the rounding of double arithmetic


def limit(width: int) -> int:
    """The largest scaled component: two parts of such numbers are less than 2 ** 63 apart, squared."""
    return min(isqrt(((1 << 63) - 1) // max(width, 1)) // 2, (1 << 31) - 1)


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows with finite vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & finite)


def scaled(vectors: list | pa.Array, width: int) -> np.ndarray:
    """int64[vector, part, width] of floor(SCALE * x)."""
    column = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), PARTS * width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    most = float(limit(width))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -most, most).astype(np.int64).reshape(len(size), PARTS, width)


def up(x: np.ndarray) -> np.ndarray:
    """A 16-bit float above x."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float16), np.float16(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """A 16-bit float below x, 0 at least."""
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter(np.minimum(x, 65504.0).astype(np.float16), np.float16(-np.inf)), np.float16(0))


class Codebooks:
    """Integer entries [part, entry, width] of one round, how far they lie apart, and how far they moved since the last."""

    def __init__(self, entries: np.ndarray, unit: float, before: np.ndarray | None = None):
        self.entries, self.unit = entries, unit
        apart = np.sqrt(squared(entries[:, :, None], entries[:, None])) * unit / 2 / _SURE
        self.half = apart
        apart = apart.copy()
        apart[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
        self.nearest = apart.min(axis=2)
        self.moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(squared(entries, before)) * unit * _SURE

    def root(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(squares) * self.unit

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bounds, lower bounds) of vectors that have none yet: all distances."""
        each = [squared(x[:, p, None], self.entries[p][None]) for p in range(PARTS)]
        squares = np.stack(each, axis=1)  # vector, part, entry
        entry = squares.argmin(axis=2)
        return entry.astype(np.uint8), up(self.root(squares.min(axis=2))), down(self.root(squares))

    def next(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries moved, and how many distances that took."""
        entry, took = entry.copy(), 0
        parts = np.arange(PARTS)
        upper = up(upper.astype(float) + self.moved[parts, entry])
        lower = down(lower.astype(float) - self.moved[None])
        for p in range(PARTS):
            rows = np.flatnonzero(upper[:, p] >= self.nearest[p, entry[:, p]])
            left = self._left(p, entry[rows, p], upper[rows, p], lower[rows, p])
            some = left.any(axis=1)
            rows, left = rows[some], left[some]
            if not len(rows):
                continue
            old, n = entry[rows, p], np.arange(len(rows))
            own = squared(x[rows, p], self.entries[p, old])
            upper[rows, p] = up(self.root(own))
            lower[rows, p, old] = down(self.root(own))
            left &= self._left(p, old, upper[rows, p], lower[rows, p])
            r, e = np.nonzero(left)
            found = squared(x[rows[r], p], self.entries[p, e])
            lower[rows[r], p, e] = down(self.root(found))
            took += len(rows) + len(r)
            exact = np.full(left.shape, np.iinfo(np.int64).max)
            exact[r, e] = found
            exact[n, old] = own
            new = exact.argmin(axis=1)
            entry[rows, p], upper[rows, p] = new, up(self.root(exact[n, new]))
        return entry, upper, lower, took

    def _left(self, p: int, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Entries that the bounds do not strictly leave out."""
        left = (upper[:, None] >= lower) & (upper[:, None] >= self.half[p, entry])
        left[np.arange(len(entry)), entry] = False
        return left

    def errors(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return squared(x, self.entries[np.arange(PARTS), entry]).sum(axis=1)

    def sums(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """int64[part, entry, width + 1]: sums of the parts by entry, and how many they are. Exact: a batch is under 2 ** 22 rows of 31 bits."""
        k, width = self.entries.shape[1:]
        out = np.empty((PARTS, k, width + 1), np.int64)
        for p in range(PARTS):
            for i in range(width):
                out[p, :, i] = np.bincount(entry[:, p], weights=x[:, p, i], minlength=k).astype(np.int64)
            out[p, :, width] = np.bincount(entry[:, p], minlength=k)
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Layout:
    """How a vector and its bounds are packed into two binary columns."""

    def __init__(self, width: int, entries: int, most: int):
        self.width, self.entries, self.kind = width, entries, np.dtype("<i2" if most < 1 << 15 else "<i4")
        self.state = np.dtype([("entry", "u1", PARTS), ("upper", "<f2", PARTS), ("lower", "<f2", (PARTS, entries))])

    def vectors(self, column: pa.Array) -> np.ndarray:
        return _joined(column, self.kind).astype(np.int64).reshape(len(column), PARTS, self.width)

    def packed(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> list[pa.Array]:
        state = np.empty(len(x), self.state)
        state["entry"], state["upper"], state["lower"] = entry, upper, lower
        return [_split(x.astype(self.kind).reshape(len(x), -1)), _split(state)]

    def unpacked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        state = _joined(column, self.state)
        return state["entry"], state["upper"], state["lower"]


def _joined(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _split(rows: np.ndarray) -> pa.Array:
    size, raw = rows.itemsize * int(np.prod(rows.shape[1:], dtype=np.int64)), rows.tobytes()
    return pa.array([raw[i * size : (i + 1) * size] for i in range(len(rows))], pa.binary())


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), BATCH):
            yield batch.slice(low, BATCH)


def moved_once(rows: DataFrame, books: Codebooks, layout: Layout, first: bool) -> str:
    """The path of the next state: vec_id, label, vector, state; and a row with sums for each task that had rows."""
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, vector binary, state binary, sums binary"
    types = [pa.int64(), None]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = None, ["vec_id", "label", "vector", "state", "sums"]
        for batch in _in_parts(it):
            types[1] = batch.column("label").type
            if first:
                x = scaled(batch.column("embedding"), layout.width)
                state = books.first(x)
            else:
                x = layout.vectors(batch.column("vector"))
                state = books.next(x, *layout.unpacked(batch.column("state")))[:3]
            sums = books.sums(x, state[0])
            total = sums if total is None else total + sums
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), *layout.packed(x, *state), pa.nulls(len(batch), pa.binary())], names)
        if total is not None:
            yield pa.record_batch([pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    path = fresh_path(rows.sparkSession, "codes-state")
    rows.mapInArrow(batches, schema).write.parquet(path)
    return path


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the tasks, cell by cell."""
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            total = np.frombuffer(raw, np.int64)
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "total"])


def updated(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after a round: floors of means, those without parts unchanged."""
    cells = state.where("sums IS NOT NULL").select("sums").mapInArrow(_cells, "cell int, total long")
    found = {r["cell"]: int(r["total"]) for r in cells.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}  # as many as numbers in the codebooks
    _, k, width = entries.shape
    out = entries.copy()
    for p in range(PARTS):
        for e in range(k):
            at = (p * k + e) * (width + 1)
            if n := found[at + width]:
                out[p, e] = [found[at + i] // n for i in range(width)]
    return out


def digest_of(entries: np.ndarray) -> str:
    """SHA-256 of all components, joined by commas in the order of parts, entries and places."""
    return sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(rows vec_id, label, code, error; codebooks [part, entry, width]). vectors: vec_id, embedding, label."""
    rows = kept(vectors)
    magnitude = F.coalesce(F.array_max(F.transform("embedding", F.abs)), F.lit(0.0))
    size, peak = rows.agg(F.max(F.size("embedding")), F.max(magnitude)).first()
    width = -(-(size or 0) // PARTS)
    most = int(min(SCALE * (peak or 0.0) + 1, limit(width)))
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    entries = scaled([r["embedding"] for r in head], width).transpose(1, 0, 2).copy()
    layout = Layout(width, len(head), most)
    unit = 2.0 ** np.floor(np.log2(60000 / max(1.0, 2 * most * max(width, 1) ** 0.5)))
    shape = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    spark, before, path = vectors.sparkSession, None, None
    if not head:
        return spark.createDataFrame([], shape), entries
    for number in range(ROUNDS):
        now = moved_once(rows, Codebooks(entries, unit, before), layout, number == 0)
        if path is not None:
            removed(path)
        path = now
        state = spark.read.parquet(path)
        before, entries = entries, updated(state, entries)
        rows = state.where("sums IS NULL").select("vec_id", "label", "vector", "state")
    books = Codebooks(entries, unit, before)

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(it):
            x = layout.vectors(batch.column("vector"))
            entry = books.next(x, *layout.unpacked(batch.column("state")))[0]
            code = entry.tobytes().hex()
            codes = pa.array([code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), codes, pa.array(books.errors(x, entry))], ["vec_id", "label", "code", "error"])

    out = staged(rows.mapInArrow(coded, shape), "codes")
    removed(path)
    return out, entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector, and the digest of the codebooks."""
    rows, entries = compressed(table(spark, sf_dir, "embeddings"))
    key = F.concat(F.col("label").isNull().cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    rows = rows.select("vec_id", "code", "error", key.alias("label_key"))
    labels = staged(rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("count")), "codes-labels")
    out = lookup(rows, labels.select("label_key", "label_error"), "label_key", labels)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(entries)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Lloyd rounds by full search, unrolled."""
    books = "b0 AS (SELECT n - 1 AS entry, part, i, v FROM comps WHERE n <= 16)"
    rounds = [books]
    for r in range(ROUNDS + 1):
        rounds.append(f"d{r} AS (SELECT n, part, entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS far FROM comps c JOIN b{r} b USING (part, i) GROUP BY ALL)")
        rounds.append(f"a{r} AS MATERIALIZED (SELECT n, part, arg_min(entry, far * 16 + entry) AS entry, min(far) AS far FROM d{r} GROUP BY n, part)")
        if r < ROUNDS:
            rounds.append(f"m{r} AS (SELECT entry, part, i, sum(c.v)::BIGINT AS s, count(*) AS k FROM comps c JOIN a{r} USING (n, part) GROUP BY ALL)")
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT b.entry, b.part, b.i, coalesce((s - ((s % k) + k) % k) // k, b.v) AS v FROM b{r} b LEFT JOIN m{r} USING (entry, part, i))")
    return f"""
WITH given AS MATERIALIZED (SELECT *, row_number() OVER () AS place FROM embeddings WHERE embedding IS NOT NULL),
dropped AS (SELECT DISTINCT place FROM (SELECT place, unnest(embedding) AS x FROM given) WHERE x IS NULL OR NOT isfinite(x)),
vecs AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, len(embedding) // 8 AS width FROM given
  WHERE place NOT IN (SELECT place FROM dropped)),
flat AS (SELECT n, width, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM vecs),
comps AS MATERIALIZED (SELECT n, j // width AS part, j % width AS i, floor(4096 * x)::BIGINT AS v FROM flat),
{", ".join(rounds)},
codes AS (SELECT n, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY n),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM vecs JOIN codes USING (n), books
"""


OP12_SQL = _op12_sql()
