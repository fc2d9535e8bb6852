"""What all sources have in common: capabilities, lookup by name and the shape of what a scan returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import did_you_mean, instant_ms, local_date, percent_decoded
from ..operators.ordered import with_line_ordinals
from ..schema import COLUMNS, USAGE
from .many import LISTERS, Below


@dataclass(frozen=True)
class Capabilities:
    """What reports a source supports."""

    projects: bool = False
    blocks: bool = False
    endpoints: bool = False
    tools: bool = False
    quota: bool = False
    reasoning: bool = False
    cache_creation: bool = False
    cache_read: bool = True
    dedup: bool = True
    #: Whether scan takes the wanted dates, to read less.
    ranged: bool = False


@dataclass(frozen=True)
class Source:
    """A kind of log: scan takes (spark, root, zone) and returns usage facts with a column rejected for lines that do not parse."""

    name: str
    aliases: tuple[str, ...]
    capabilities: Capabilities
    scan: Callable[..., DataFrame]
    label: str = ""

    def facts(self, spark: SparkSession, root: str, zone: str = "UTC", **options) -> tuple[DataFrame, DataFrame]:
        """(usage facts before dedup, one row with parse_errors)."""
        rows = self.scan(spark, root, zone, **options)
        return rows.where("NOT rejected").select(*COLUMNS), rows.agg(F.count_if("rejected").alias("parse_errors"))


def combined(sources: list[Source]) -> Capabilities:
    """Of all sources together: anything that one supports, but cache reads only if all do."""
    values = {f.name: any(getattr(s.capabilities, f.name) for s in sources) for f in fields(Capabilities)}
    values["cache_read"] = bool(sources) and all(s.capabilities.cache_read for s in sources)
    return Capabilities(**values)


ALL = "all"


class Registry(dict):
    """Sources by lower-case name, and all of them together as ``all``."""

    def _scan_all(self, spark: SparkSession, roots: dict[str, str], zone: str = "UTC") -> DataFrame:
        """Facts of every source that has a root."""
        parts = [self.find(name).scan(spark, root, zone) for name, root in roots.items()]
        if not parts:
            raise ValueError("all sources need a root each, by name")
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def find(self, name: str) -> Source:
        """By name or alias, whatever the case."""
        wanted = name.strip().lower()
        if wanted == ALL:
            return Source(ALL, (), combined(list(self.values())), self._scan_all, "All Sources")
        for s in self.values():
            if wanted == s.name or wanted in s.aliases:
                return s
        near = did_you_mean(wanted, [x for s in self.values() for x in (s.name, *s.aliases)] + [ALL])
        raise KeyError(f"no source {name!r}" + (f"; did you mean {near!r}?" if near else ""))


def no_path(error: Exception) -> bool:
    """Whether reading failed because a path is not there."""
    return "PATH_NOT_FOUND" in str(error)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders that are listed inside share LISTERS tasks a core; Spark alone takes one for each folder, up to 10,000, and each task's own result was most of what the driver got."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, str(LISTERS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def text_files(spark: SparkSession, paths: str | list[str], pattern: str, **options) -> DataFrame | None:
    """Text of the files below a path, null if it is not there."""
    try:
        with listing(spark):
            return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, **options)
    except Exception as e:
        if not no_path(e):
            raise
        return None


def json_lines(
    spark: SparkSession, paths: str | list[str], schema: str, pattern: str = "*.jsonl", needle: str | None = None, below: Below | None = None, beside: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Lines of JSON files below a path: file_path, line_ord, part, value, j (typed) and rejected; none if the path is not there.

    A value of the wrong type in a typed field rejects the whole line. needle filters lines before they are parsed. below is a listing made before.
    beside joins columns to files by their file_path; it is asked only of many files, where no line then takes part in a join, and the caller sees it by the columns.
    """
    below = below or Below.of(spark, paths, pattern)
    if below.files is not None:
        lines = below.lines(pattern, beside)
    else:
        text = text_files(spark, paths, pattern)
        lines = with_line_ordinals(text) if text is not None else spark.createDataFrame([], "value string, file_path string, line_ord long, part long")
    lines = lines.where(F.trim("value") != "")
    if needle is not None:
        lines = lines.where(F.col("value").contains(needle))
    parsed = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.select("*", F.explode(F.array(parsed)).alias("j"))  # each line is parsed once: filters on j would go below a projection and parse there again
    return rows.withColumn("rejected", F.col("j").isNull() | F.col("j.__bad").isNotNull())


def whole_json(spark: SparkSession, root: str, pattern: str, schema: str, below: Below | None = None) -> DataFrame:
    """Whole-file JSON documents: file_path and j; none if the path is not there."""
    return whole_text(spark, root, pattern, below).select("file_path", "value", F.from_json("value", schema).alias("j"))


def whole_text(spark: SparkSession, root: str, pattern: str, below: Below | None = None) -> DataFrame:
    """Whole files: file_path and value; none if the path is not there."""
    below = below or Below.of(spark, root, pattern)
    if below.files is not None:
        return below.texts(pattern)
    text = text_files(spark, root, pattern, wholetext=True)
    if text is None:
        return spark.createDataFrame([], "file_path string, value string")
    return text.select(percent_decoded(F.col("_metadata.file_path")).alias("file_path"), "value")


def usage(df: DataFrame, zone: str, **columns: Column) -> DataFrame:
    """Rows in the canonical shape; missing columns are null or 0. columns must have timestamp (text) or timestamp_ms."""
    ms = columns.pop("timestamp_ms", None)
    text = columns.pop("timestamp", None)
    ms = instant_ms(text) if ms is None else ms
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if text is None else text
    values = {"timestamp": text, "timestamp_ms": ms, "date": local_date(ms, zone), "call_count": F.lit(1), "cost_kind": F.lit("real"), "endpoint": F.lit("unknown"), "file_path": F.col("file_path"), "line_ord": F.col("line_ord"), **columns}
    types = dict(x.split() for x in USAGE.split(", "))
    zero = {c for c, t in types.items() if t == "long" and c not in ("timestamp_ms", "line_ord")}
    made = [values.get(c, F.lit(0 if c in zero else None)).cast(types[c]).alias(c) for c in COLUMNS]
    return df.select(*made, F.coalesce("rejected", F.lit(False)).alias("rejected"))


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def part_from_end(path: Column, n: int) -> Column:
    """The n-th component of a path from its end, 1 is the last."""
    return F.try_element_at(F.split(path, "/"), F.lit(-n))
