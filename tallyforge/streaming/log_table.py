"""A durable table of the last record for each key, as a log of sorted-out segments.

Each batch adds one segment with its own rows only, so what is written follows the batch. FAN segments of a level are merged into one
of the next, so a table of n batches has fewer than FAN segments on each of about log(n) levels, and a row is rewritten once a level. Segments
are dealt into files by the hash of the key, as many as their size asks for.

A manifest names the live segments, oldest first, and the last batch. Commits number the manifests: a writer puts the next number in place by a rename
that does not replace, so of two writers that started from one manifest the second fails (Conflict) and can start over. Readers see whole manifests only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 8


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


@dataclass(frozen=True)
class Segment:
    """Rows with unique keys."""

    name: str
    level: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    """Live segments, oldest first; rows of later ones win. retired are those that it replaced; they go with the commit after it."""

    number: int = -1
    batch: int = -1
    segments: tuple[Segment, ...] = field(default=())
    retired: tuple[str, ...] = field(default=())


class Folder:
    """The few file operations that a commit needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.hadoop = self.jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(self.conf)

    def at(self, name: str):
        return self.hadoop.fs.Path(self.path, name)

    def names(self, name: str) -> list[str]:
        place = self.at(name)
        return sorted(f.getPath().getName() for f in self.files.listStatus(place)) if self.files.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a whole file unless it is there; False if it is."""
        held = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(held, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        none = self.gateway.new_array(options, 1)
        none[0] = options.NONE
        place = self.at(name)
        context = self.hadoop.fs.FileContext.getFileContext(self.files.makeQualified(place).toUri(), self.conf)
        try:
            context.rename(self.files.makeQualified(held), self.files.makeQualified(place), none)
        except Exception as e:
            self.files.delete(held, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.files.delete(self.at(name), True)


class LogTable:
    """The table below path. key names its rows, order says which of several rows of a batch counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.folder = Folder(spark, self.path)

    def manifest(self) -> Manifest:
        """The newest."""
        names = [n for n in self.folder.names("manifest") if not n.endswith(".tmp")]
        while names:
            name = names.pop()
            try:
                found = json.loads(self.folder.read(f"manifest/{name}"))
            except Exception as e:  # an older one may be removed while it is read
                if "FileNotFound" not in str(e):
                    raise
                return self.manifest()
            return Manifest(int(name), found["batch"], tuple(Segment(**s) for s in found["segments"]), tuple(found["retired"]))
        return Manifest()

    def _rows(self, segments: tuple[Segment, ...]) -> list[DataFrame]:
        return [self.spark.read.schema(self.schema).parquet(f"{self.path}/segments/{s.name}") for s in segments]

    def _last(self, parts: list[DataFrame]) -> DataFrame:
        """Of parts, oldest first, the last row of each key. The largest part is not moved for the sake of small ones that follow it."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return parts[0]
        first, rest = parts[0], reduce(DataFrame.unionByName, [p.withColumn("__at", F.lit(i)) for i, p in enumerate(parts[1:])])
        rest = rest.groupBy(self.key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in first.columns]), "__at").alias("row")).select("row.*")
        return first.join(rest.select(self.key), self.key, "left_anti").select(*first.columns).unionByName(rest)

    def read(self) -> DataFrame:
        """The newest whole table."""
        return self._last(self._rows(self.manifest().segments))

    def add(self, rows: DataFrame) -> None:
        """Merge rows as the batch after the last."""
        self.merge(rows, self.manifest().batch + 1)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function; a batch that was merged before changes nothing."""
        self.commit(self.manifest(), batch, batch_id)

    def commit(self, seen: Manifest, batch: DataFrame, batch_id: int) -> None:
        """Merge rows into what a manifest says; Conflict if another writer did so first. Rows without a key are left out."""
        if seen.batch >= batch_id:
            return
        columns = StructType.fromDDL(self.schema).fieldNames()
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        fresh = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(row, F.struct(self.order)).alias("row")).select("row.*")
        segments, made = list(seen.segments), []
        if (segment := self._written(fresh, 0)) is not None:
            made.append(segment)
            segments.append(segment)
        while (full := self._full(segments)) is not None:
            run = [s for s in segments if s.level == full]  # neighbours in age
            made.append(self._written(self._last(self._rows(tuple(run))), full + 1))
            at = segments.index(run[0])
            segments[at : at + len(run)] = made[-1:]
        retired = sorted({s.name for s in (*seen.segments, *made)} - {s.name for s in segments})
        text = json.dumps({"batch": batch_id, "segments": [vars(s) for s in segments], "retired": retired})
        if not self.folder.put(f"manifest/{seen.number + 1:012d}", text):
            for s in made:
                self.folder.remove(f"segments/{s.name}")
            raise Conflict(f"manifest {seen.number + 1} is there already")
        for name in seen.retired:  # readers of the manifest before have had a whole batch to finish
            self.folder.remove(f"segments/{name}")
        for name in self.folder.names("manifest"):
            if not name.endswith(".tmp") and int(name) < seen.number:
                self.folder.remove(f"manifest/{name}")

    @staticmethod
    def _full(segments: list[Segment]) -> int | None:
        levels = [s.level for s in segments]
        return next((x for x in sorted(set(levels)) if levels.count(x) >= FAN), None)

    def _written(self, rows: DataFrame, level: int) -> Segment | None:
        """Rows as a new segment; none if there are no rows. Spark cuts the files to its advisory size."""
        name = f"{level}-{uuid.uuid4().hex}"
        rows.hint("rebalance", self.key).write.parquet(f"{self.path}/segments/{name}")
        n = self._rows((Segment(name, level, 0),))[0].count()
        if not n:
            self.folder.remove(f"segments/{name}")
            return None
        return Segment(name, level, n)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start feeding the table from a stream."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).outputMode("append")
