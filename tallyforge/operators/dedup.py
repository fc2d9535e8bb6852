"""Removal of streaming and replay duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE_WIDE = "source-wide:"
#: What decides between candidates.
IDENTITY = ("message_id", "session_key", "stop_reason", "timestamp_ms", "file_path", "line_ord")


def scope() -> Column:
    """Ids with the source-wide prefix are unique in a source, others in a session."""
    return F.when(F.col("message_id").startswith(SOURCE_WIDE), F.lit("")).otherwise(F.col("session_key"))


def counted(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (keys, scope, message_id): the latest completed one, else the latest; ties go to the first seen. Adds entries.

    One aggregate whose partial results already hold one row for each id of a task, so what is shuffled follows the ids and not
    their repeats, and no group is sorted. entries is how many rows the winner stands for. Rows without an id stay only if completed; each of them is a group by its place
    and content, and rows that agree in all of these come back as often as they were. If df has a column rejected, rejected rows
    are counted and not compared: they come back as rows with rejected, all else null, that add up to their number.
    """
    gone = F.coalesce(F.col("rejected"), F.lit(False)) if "rejected" in df.columns else F.lit(False)
    single = ~gone & F.col("message_id").isNull()
    by = {
        **{k: F.when(~gone, F.col(k)) for k in keys}, "__gone": gone, "__scope": F.when(~gone, scope()), "__id": F.when(~gone, F.col("message_id")),
        "__line": F.when(single, F.col("line_ord")), "__same": F.when(single, F.xxhash64(*[c for c in df.columns if c != "rejected"])),
    }
    rest = [c for c in df.columns if c not in (*keys, "message_id", "rejected")]
    stamp = F.col("timestamp_ms")
    order = F.struct(F.col("stop_reason").isNull(), stamp.isNull(), -stamp, "file_path", "line_ord")
    row = F.when(~gone, F.struct(*rest))
    groups = df.where(gone | F.col("message_id").isNotNull() | F.col("stop_reason").isNotNull()).select(*[c.alias(n) for n, c in by.items()], row.alias("__row"), F.when(~gone, order).alias("__order"))
    best = groups.groupBy(*by).agg(F.min_by("__row", "__order").alias("__row"), F.count("*").alias("entries"))
    again = F.when(~F.col("__gone") & F.col("__id").isNull(), F.col("entries")).otherwise(1)
    best = best.withColumn("__n", F.explode(F.array_repeat(F.lit(0), again.cast("int")))).withColumn("entries", F.when(again > 1, 1).otherwise(F.col("entries")))
    out = {c: F.col(f"__row.{c}") for c in rest} | {k: F.col(k) for k in keys} | {"message_id": F.col("__id"), "rejected": F.col("__gone")}
    return best.select(*[out[c].alias(c) for c in df.columns], "entries")


def best_candidate(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows that count: those of counted, without rejected ones."""
    best = counted(df, keys)
    return (best.where("NOT rejected") if "rejected" in df.columns else best).drop("entries")


def quality_of(best: DataFrame) -> DataFrame:
    """One row from rows of counted: how many count, how many were duplicates of those, how many lines could not be read.

    Rows without an id that are dropped do not count as skipped.
    """
    gone = F.col("rejected") if "rejected" in best.columns else F.lit(False)
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return best.agg(F.count_if(~gone).alias("valid"), add(F.when(~gone, F.col("entries") - 1)).alias("dedup_skipped"), add(F.when(gone, F.col("entries"))).alias("parse_errors"))


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key (a later record replaces an earlier one)."""
    return first_by(df, keys, F.desc(order))


def distinct_tool_calls(df: DataFrame) -> DataFrame:
    """Calls with a whole identity count once, those of the least name and date; calls without one all count."""
    identity = ["session_key", "message_id", "tool_use_id"]
    known = F.col(identity[0]).isNotNull() & F.col(identity[1]).isNotNull() & F.col(identity[2]).isNotNull()
    rest = [c for c in df.columns if c not in identity]
    once = df.where(known).groupBy(*identity).agg(F.min(F.struct(*sorted(rest, key=lambda c: (c != "name", c != "date", c)))).alias("__first"))
    return once.select(*identity, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns).unionByName(df.where(~known))


def upsert(ledger: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """ledger with the rows of new, which win; of several new rows for a key the last by order wins."""
    fresh = last_by(new, [key], order)
    return ledger.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*ledger.columns))
