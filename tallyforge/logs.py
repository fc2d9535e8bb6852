"""Log files for tests and benchmarks: lines become files, and the workloads that the benchmark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import local_path


#: Lines that a task of write_lines sorts and writes, where their number is told; a longer file is a task.
LINES = 100_000


def write_lines(df: DataFrame, root: str, lines: int | None = None) -> str:
    """Write rows (path, ord, line) as files below root, each with its lines in order; returns root.

    A task writes whole files, one after the other, each under a name of its own that is moved to the path once it is complete. With lines, about how many
    rows there are, the number of tasks grows with them; else Spark chooses it by compressed bytes, which for lines so much alike may be few tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_path(root)
        at, out, held = None, None, ""

        def close() -> None:
            out.close()
            files.move(held, f"{base}/{at}")

        for batch in batches:
            if batch.column(1).null_count:
                raise ValueError("a line is null")
            text = batch.column(1).cast(pa.large_binary())
            _, places, data = text.buffers()
            ends = memoryview(places).cast("q")[text.offset : text.offset + len(text) + 1]
            runs, first = pc.run_end_encode(batch.column(0)), 0
            for path, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if path != at:
                    if out is not None:
                        close()
                    folder, _, name = f"{base}/{path}".rpartition("/")
                    files.create_dir(folder, recursive=True)
                    at, held = path, f"{folder}/.{name}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(held, buffer_size=1 << 16)
                out.write(data.slice(ends[first], ends[last] - ends[first]))  # lines of a file lie side by side
                first = last
            yield pa.record_batch([pa.array([], pa.string())], ["path"])
        if out is not None:
            close()

    dealt = df.repartition("path") if lines is None else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-lines // LINES)), "path")
    ordered = dealt.sortWithinPartitions("path", "ord").select("path", F.concat("line", F.lit("\n")).alias("line"))
    ordered.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def as_json(*fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*fields))


def streamed_log(spark: SparkSession, root: str, files: int = 48, lines: int = 1200) -> str:
    """Streamed messages in pairs: the second of each pair completes the first."""
    pair, done = F.floor(F.col("n") / 2), F.col("n") % 2 == 1
    rows = spark.range(files * lines).select((F.col("id") % files).alias("f"), F.floor(F.col("id") / files).alias("n"))
    stamp = F.date_format(F.timestamp_seconds(1767225600 + F.col("f") * 86_400 + F.col("n") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    usage = F.struct((100 + pair % 900).alias("input_tokens"), F.when(done, 50 + pair % 450).otherwise(1).alias("output_tokens"), (pair % 64).alias("cache_creation_input_tokens"), (pair % 2048).alias("cache_read_input_tokens"))
    model = F.element_at(F.array(*map(F.lit, ("claude-sonnet-4-20250514", "claude-opus-4-20250514", "claude-haiku-4-5"))), (F.col("f") % 3 + 1).cast("int"))
    message = F.struct(F.format_string("m-%d-%d", "f", pair).alias("id"), model.alias("model"), F.when(done, "end_turn").alias("stop_reason"), usage.alias("usage"))
    path = F.format_string("projects/p%d/s%d.jsonl", F.col("f") % 6, "f")
    return write_lines(rows.select(path.alias("path"), F.col("n").alias("ord"), as_json(stamp.alias("timestamp"), message.alias("message")).alias("line")), root)


def counter_log(spark: SparkSession, root: str, files: int = 48, events: int = 600) -> str:
    """Running totals: a context line and then growing counters in each file."""
    rows = spark.range(files * (events + 1)).select((F.col("id") % files).alias("f"), F.floor(F.col("id") / files).alias("n"))
    n = F.col("n")
    stamp = F.date_format(F.timestamp_seconds(1767225600 + F.col("f") * 86_400 + n * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    totals = F.struct((n * 120).alias("input_tokens"), (n * 30).alias("cached_input_tokens"), (n * 45).alias("output_tokens"), (n * 15).alias("reasoning_output_tokens"), (n * 165).alias("total_tokens"))
    context = as_json(stamp, F.lit("turn_context").alias("type"), F.struct(F.lit("gpt-5").alias("model")).alias("payload"))
    count = as_json(stamp, F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(totals.alias("total_token_usage")).alias("info")).alias("payload"))
    path = F.format_string("sessions/2026/01/%02d/s%d.jsonl", F.col("f") % 28 + 1, "f")
    return write_lines(rows.select(path.alias("path"), n.alias("ord"), F.when(n == 0, context).otherwise(count).alias("line")), root)
