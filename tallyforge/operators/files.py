"""Reports as single files: written in order side by side, put together, and moved into place as a whole."""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import fresh_path, local_path, removed

BLOCK = 1 << 20


def saved(lines: DataFrame, path: str) -> str:
    """Write rows (part, place, line) in this order as the lines of one file; returns path.

    Ranges of lines are sorted and written by tasks under Spark's commit protocol, so those of a killed attempt do not show. Their files are
    joined block by block into a file of another name, which is then renamed: a reader sees the old file or the whole new one.
    """
    folder = fresh_path(lines.sparkSession, "report")
    lines.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select(F.col("line").alias("value")).write.text(folder)
    (parts, base), (files, target) = local_path(folder), local_path(path)
    if "/" in target.strip("/"):
        files.create_dir(target.rpartition("/")[0], recursive=True)
    held = f"{target}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(held) as out:
        for info in sorted(parts.get_file_info(FileSelector(base)), key=lambda i: i.base_name):
            if info.base_name.startswith("part-"):
                with parts.open_input_stream(info.path) as given:
                    while block := given.read(BLOCK):
                        out.write(block)
    files.move(held, target)
    removed(folder)
    return path


def json_lines(rows: DataFrame) -> DataFrame:
    """(part, place, line) of a JSON array from (place, json): an object a line."""
    at = lambda part, line: rows.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(1).cast("long").alias("place"), F.lit(line).alias("line"))
    comma: Column = F.when(F.col("place") == 1, "").otherwise(",")
    return at(0, "[").unionByName(rows.select(F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), F.concat(comma, "json").alias("line"))).unionByName(at(2, "]"))


def text_lines(text: str, spark) -> DataFrame:
    """(part, place, line) of a finished table."""
    return spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"), 1)], "part int, place long, line string")
