"""Tables that a job writes for itself, in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_tables: dict[str, str] = {}


@lru_cache(1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local session (one machine, as in tests) may leave it unset and then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_dir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing will read again."""
    for table in tables:
        if (path := _staged.pop(table, None)) is not None:
            if name := _tables.pop(path, None):
                table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            removed(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like staged, but in buckets by key, one for each partition of a shuffle, so that joins by key leave the rows where they are."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    _staged[out], _tables[path] = path, table
    return out


def local_path(uri: str) -> tuple:
    """(pyarrow file system, path) for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def removed(path: str) -> None:
    """Remove a folder that fresh_path gave, once nothing reads it any more."""
    files, base = local_path(path)
    files.delete_dir_contents(base, missing_dir_ok=True)
    files.delete_dir(base)
    _written.discard(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        try:
            removed(path)
        except Exception:  # never written, or the store is gone: nothing is left to do for a process that ends
            pass
