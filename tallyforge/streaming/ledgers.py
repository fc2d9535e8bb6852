"""Streams of usage facts: best candidates and blocks that are corrected as late rows come, on Spark's own streaming aggregates.

State is bounded by the watermark. Emitted rows are for a table that keeps the last row of each key, such as a LogTable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import sums, with_cost_parts
from ..operators.dedup import scope
from ..operators.reports import BLOCK_HOURS, with_block
from .log_table import Conflict, LogTable  # noqa: F401

Ledger = LogTable


def best_candidates(stream: DataFrame, lateness: str = "1 hour", span: str = "1 day") -> DataFrame:
    """The best candidate so far of each (scope, message_id) and span of event time, whenever it improves, with all columns (update mode); rows without an id that are
    complete pass through.

    A span is over once the watermark has passed it, and its state goes. Every row that is emitted is a row of the stream, and the best of each span
    is among them, so dedup.best_candidate over what was emitted equals that over the stream (but for rows later than the lateness).
    """
    at = F.timestamp_millis("timestamp_ms")
    rows = stream.withColumn("__at", at).withWatermark("__at", lateness)
    rest = [c for c in stream.columns if c not in ("message_id",)]
    order = F.struct(F.col("stop_reason").isNull(), -F.col("timestamp_ms"), "file_path", "line_ord")
    known = rows.where("message_id IS NOT NULL").groupBy(F.window("__at", span), scope().alias("__scope"), "message_id")
    best = known.agg(F.min_by(F.struct(*rest), order).alias("__row"))
    best = best.select(*[F.col("message_id") if c == "message_id" else F.col(f"__row.{c}").alias(c) for c in stream.columns])
    return best.unionByName(rows.where("message_id IS NULL AND stop_reason IS NOT NULL").select(*stream.columns))


def blocks(stream: DataFrame, zone: str = "UTC", lateness: str = "1 hour") -> DataFrame:
    """All measures by five-hour block of local days, UTC offset and model, as reports.blocks has them, whenever they change (update mode).

    The start of a block as an instant (block_at) is the event time: it is up to BLOCK_HOURS, and a clock change, before a row, so the watermark waits that much longer.
    """
    rows = with_block(stream, zone)
    start = F.col("block_start") - F.make_dt_interval(mins=F.col("utc_offset").cast("int"))
    rows = rows.withColumn("block_at", start).withWatermark("block_at", f"{BLOCK_HOURS + 2} hours {lateness}")
    return with_cost_parts(rows).groupBy("block_at", "block_start", "utc_offset", "model").agg(*sums())
