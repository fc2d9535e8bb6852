"""Folders of many files, listed and read by tasks.

Spark's readers hold an object for each file in the driver and plan a task for each few of them. Logs with files for each session soon have a million;
then tasks list the folders, the listing is a staged table, and tasks read the files that it deals to them.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import released, staged

#: Files of at most so many are left to Spark's readers.
FEW_FILES = 1000
#: Folders that a task opens in the first round of a listing, and how many times as many in each round after.
OPENED, MORE = 256, 16
#: Tasks of a listing for each core.
LISTERS = 4
#: Bytes that a task reads of a file at once, what it hands on at once, and what opening a file costs in bytes read.
BLOCK, OPENING = 1 << 20, 1 << 14
#: Bytes that a task reads, where Spark's own limit is not less.
TASK_BYTES = 1 << 25
FOUND = "path string, size long, folder boolean"


def store(root: str) -> tuple | None:
    """(file system, path in it, what comes before a path in a URI); null for patterns and for stores that pyarrow does not know."""
    from pyarrow import fs

    if any(c in root for c in "*?[]{}\\"):
        return None
    if urlparse(root).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + os.path.abspath(root.removeprefix("file:")).lstrip("/"), "file://"
    root = root.rstrip("/")
    try:
        files, path = fs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError):
        return None
    return (files, path, root.removesuffix(path)) if path and root.endswith(path) else None


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a name."""
    return (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def walked(folders: DataFrame, root: str, patterns: tuple[str, ...], most: int) -> DataFrame:
    """Files below folders by name, and folders that are still to be opened, as each task opens at most so many."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files = store(root)[0]
        todo, out, opened = deque(p for batch in batches for p in batch.column("path").to_pylist()), [], 0
        made = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_()))], ["path", "size", "folder"])
        while todo and opened < most:
            opened += 1
            for one in files.get_file_info(fs.FileSelector(todo.popleft())):
                if hidden(one.base_name):
                    continue
                if one.type == fs.FileType.Directory:
                    todo.append(one.path)
                elif one.type == fs.FileType.File and any(fnmatchcase(one.base_name, p) for p in patterns):
                    out.append((one.path, one.size, False))
                    if len(out) == 10_000:
                        yield made()
                        out.clear()
        for path in todo:
            out.append((path, 0, True))
            if len(out) == 10_000:
                yield made()
                out.clear()
        if out:
            yield made()

    return folders.select("path").mapInArrow(walk, FOUND)


def many(spark: SparkSession, root: str, *patterns: str) -> DataFrame | None:
    """(path, size, file_path) of the files below a folder whose names fit one of patterns, if there are many; the driver sees only how many.

    Folders are listed in rounds. In each, a task opens some of the folders dealt to it and what it finds in them, and the rest is dealt anew, so that neither one large
    folder nor a deep one stays with one task. null if there are few, or none, or Spark has to read them.
    """
    place = store(root)
    if place is None or not urlparse(root).scheme and not spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("file:"):
        return None
    from pyarrow import fs

    files, base, before = place
    if files.get_file_info(base).type != fs.FileType.Directory:
        return None
    tasks, most, left, parts = LISTERS * spark.sparkContext.defaultParallelism, OPENED, 1, []
    folders = spark.createDataFrame([(base,)], "path string")
    while left:
        step = staged(walked(folders.repartition(min(tasks, left)), root, patterns, most), "listing")
        left, seen = step.agg(F.count_if("folder"), F.count_if(~F.col("folder"))).first()
        if not left and not parts and seen <= FEW_FILES:
            released(step)
            return None
        parts.append(step.where("NOT folder"))
        folders, most = step.where("folder"), most * MORE
    return reduce(DataFrame.unionByName, parts).select("path", "size", F.concat(F.lit(before), "path").alias("file_path"))


@dataclass(frozen=True)
class Below:
    """What lies below a folder: files, the listing of those that fit patterns, is null where Spark's readers do."""

    root: str
    patterns: tuple[str, ...]
    files: DataFrame | None

    @classmethod
    def of(cls, spark: SparkSession, root: str | list[str], *patterns: str) -> Below:
        return cls(root, patterns, many(spark, root, *patterns) if isinstance(root, str) else None)

    def named(self, pattern: str) -> DataFrame:
        """Those of one of patterns."""
        return self.files if self.patterns == (pattern,) else self.files.where(F.col("path").endswith(f"/{pattern}"))

    def lines(self, pattern: str, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Lines of files in the shape of ordered.with_line_ordinals. beside adds columns to files by file_path, which each line then has.

        Files are read by blocks, and long ones in parts; a line's place is where its block begins and its number in the block.
        """
        root = self.root

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(rest: pa.RecordBatch, found: list) -> pa.RecordBatch:
                texts = [(t[3:] if at == 0 and t.startswith(b"\xef\xbb\xbf") else t).splitlines() for _, at, t in found]
                start, at, _ = zip(*found)
                return pa.record_batch([*rest.columns, pa.array(start, pa.int64()), pa.array(at, pa.int64()), pa.array(texts, pa.list_(pa.binary()))], [*rest.schema.names, "part", "at", "lines"])

            return _handed_on(batches, root, pieces, made)

        parts = _dealt(self.named(pattern), beside)
        rows = parts.mapInArrow(read, _with(parts, "part long, at long, lines array<binary>"))
        rest = [c for c in rows.columns if c not in ("part", "at", "lines", "file_path")]
        each = rows.select(*rest, "file_path", "part", "at", F.posexplode("lines").alias("pos", "value"))
        return each.select(F.col("value").cast("string").alias("value"), "file_path", (F.col("at") + F.col("pos")).alias("line_ord"), "part", *rest)

    def texts(self, pattern: str) -> DataFrame:
        """Whole files: file_path and value."""
        root = self.root

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(rest: pa.RecordBatch, found: list) -> pa.RecordBatch:
                return pa.record_batch([*rest.columns, pa.array([t for _, _, t in found], pa.binary())], [*rest.schema.names, "value"])

            return _handed_on(batches, root, lambda f, start, end: [(start, f.read())] if start == 0 else [], made)

        parts = _dealt(self.named(pattern))
        return parts.mapInArrow(read, _with(parts, "value binary")).select("file_path", F.col("value").cast("string").alias("value"))


def pieces(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the lines that begin in a part of a file, in pieces of about BLOCK that end with a line."""
    at, held, within = max(start - 1, 0), b"", start == 0  # a line that begins at start follows the line end before it
    f.seek(at)
    while block := f.read(BLOCK):
        if not within:
            cut = block.find(b"\n") + 1
            at += cut or len(block)
            if at >= end:
                return
            if not cut:
                continue
            block, within = block[cut:], True
        held += block
        if at + len(held) >= end:
            if cut := held.find(b"\n", max(end - 1 - at, 0)) + 1:
                yield at, held[:cut]
                return
        elif cut := held.rfind(b"\n") + 1:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]
    if held:
        yield at, held


def _dealt(files: DataFrame, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Parts of files (start, end) beside their other columns, dealt to tasks by what these read and open."""
    spark = files.sparkSession
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    part = min(limit, TASK_BYTES)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size + n * OPENING) // part))
    given = files if beside is None else beside(files)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(part).cast("long"))).alias("start")
    rest = [c for c in given.columns if c != "size"]
    return given.select("size", *rest, starts).select(*rest, "start", F.least(F.col("start") + part, "size").alias("end")).repartition(tasks)


def _handed_on(batches: Iterator[pa.RecordBatch], root: str, read, made) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK bytes with what read gives for each part, beside the columns of the part."""
    files = store(root)[0]
    for batch in batches:
        rest = batch.drop_columns(["path", "start", "end"])
        rows, found, size = [], [], 0
        for i, (path, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")))):
            with files.open_input_file(path) as f:
                for at, text in read(f, start, end):
                    rows.append(i)
                    found.append((start, at, text))
                    size += len(text) + 100
                    if size >= BLOCK:
                        yield made(rest.take(pa.array(rows)), found)
                        rows, found, size = [], [], 0
        if rows:
            yield made(rest.take(pa.array(rows)), found)


def _with(parts: DataFrame, more: str) -> StructType:
    """The columns that _handed_on keeps of parts, and more."""
    return StructType([f for f in parts.schema if f.name not in ("path", "start", "end")] + StructType.fromDDL(more).fields)
