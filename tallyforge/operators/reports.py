"""Group-by reports over deduplicated usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import resums, sums, total_tokens, with_cost_parts
from ..functions.scalars import endpoint_order

BLOCK_HOURS = 5


def in_range(df: DataFrame, since=None, until=None, always: Column | None = None) -> DataFrame:
    """Rows with since <= date <= until, and those for which always holds; either side may be open. Apply before dedup."""
    also = F.lit(False) if always is None else always
    if since is not None:
        df = df.where(also | (F.col("date") >= F.lit(since).cast("date")))
    if until is not None:
        df = df.where(also | (F.col("date") <= F.lit(until).cast("date")))
    return df


#: What a report of rows from dedup.counted knows besides its sums; rejected lines are a group of their own.
COUNTERS = ("skipped", "errors")


def counters() -> list[Column]:
    """Aggregates for COUNTERS, in the pass that adds up the measures."""
    add = lambda c: F.sum(c).cast("long")
    return [add(F.when(F.col("rejected"), 0).otherwise(F.col("entries") - 1)).alias("skipped"), add(F.when(F.col("rejected"), F.col("entries")).otherwise(0)).alias("errors")]


def quality(told: DataFrame) -> DataFrame:
    """One row with valid, dedup_skipped and parse_errors from sums by any keys and rejected, with COUNTERS."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return told.agg(add(F.when(~F.col("rejected"), F.col("entries"))).alias("valid"), add("skipped").alias("dedup_skipped"), add("errors").alias("parse_errors"))


def by(df: DataFrame, *keys: str | Column, more: tuple[Column, ...] = ()) -> DataFrame:
    """Sums of all measures by keys."""
    return with_cost_parts(df).groupBy(*keys).agg(*sums(), *more)


def daily(df: DataFrame) -> DataFrame:
    """By date and model, the finest grain; coarser reports sum these rows."""
    return by(df, "date", "model")


def weekly(days: DataFrame) -> DataFrame:
    """Weeks start on Monday."""
    return days.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week"), "model").agg(*resums())


def monthly(days: DataFrame) -> DataFrame:
    """By YYYY-MM."""
    return days.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "model").agg(*resums())


def models(days: DataFrame) -> DataFrame:
    """Totals by model."""
    return days.groupBy("model").agg(*resums())


def with_total(rows: DataFrame, key: str) -> DataFrame:
    """Adds a total row for each key (level 1, model null) and over all (level 3), in one pass."""
    return rows.rollup(key, "model").agg(*resums(), F.grouping_id().alias("level"))


def sessions(df: DataFrame, *more: str, at: bool = False, told: tuple[Column, ...] = ()) -> DataFrame:
    """By session (and more): id and project of the first row, first and last timestamp, the aggregates told; with at also the least column __at."""
    first = F.struct("timestamp_ms", "file_path", "line_ord")
    key = F.coalesce("session_key", "session_id").alias("session_key")
    return with_cost_parts(df).groupBy(key, *more).agg(
        F.min_by("session_id", F.struct("file_path", "line_ord")).alias("session_id"),
        F.min_by("project_path", F.struct("file_path", "line_ord")).alias("project_path"),
        F.min_by("timestamp", first).alias("first_timestamp"), F.max_by("timestamp", first).alias("last_timestamp"),
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), *sums(), *told, *([F.min("__at").alias("__at")] if at else []),
    )


def session_parts(df: DataFrame, *more: str, told: tuple[Column, ...] = ()) -> DataFrame:
    """By session and model (and more), with what session_whole needs."""
    return sessions(df.withColumn("__at", F.struct("file_path", "line_ord")), "model", *more, at=True, told=told)


def session_models(df: DataFrame) -> DataFrame:
    """By session and model; id, project and span are those of the whole session. session_rows is 1 in one row of each session."""
    return session_whole(session_parts(df))


def session_whole(rows: DataFrame) -> DataFrame:
    """session_parts, each with the id, project and span of the whole session."""
    whole = Window.partitionBy("session_key")  # a row for each model of a session
    first, last = F.struct("first_ms", "__at"), F.struct("last_ms", "__at")
    named = {"session_id": F.min_by("session_id", "__at"), "project_path": F.min_by("project_path", "__at"), "first_timestamp": F.min_by("first_timestamp", first), "last_timestamp": F.max_by("last_timestamp", last), "first_ms": F.min("first_ms"), "last_ms": F.max("last_ms")}
    told = rows.select(*[c for c in rows.columns if c not in (*named, "__at")], *[x.over(whole).alias(n) for n, x in named.items()], F.row_number().over(whole.orderBy("model")).alias("__n"))
    return told.withColumn("session_rows", (F.col("__n") == 1).cast("long")).drop("__n")


def project_models(session_rows: DataFrame) -> DataFrame:
    """By project and model from session_models; sessions counts each session once, under one of its models."""
    return session_rows.groupBy("project_path", "model").agg(F.sum("session_rows").alias("session_rows"), *resums())


def projects(session_rows: DataFrame) -> DataFrame:
    """By project of sessions: a session belongs to the project it began in."""
    return session_rows.groupBy("project_path").agg(F.count("*").alias("session_count"), *resums())


def block_start(ts_ms: Column, zone: str = "UTC") -> Column:
    """Local start of the five-hour block; the grid begins anew at midnight."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)
    hour = F.floor(F.hour(local) / BLOCK_HOURS) * BLOCK_HOURS
    return F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), hour.cast("int"))


def with_block(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Adds block_start and utc_offset (minutes): an hour that a clock shows twice is two blocks."""
    offset = F.expr(f"timestampdiff(MINUTE, timestamp_millis(timestamp_ms), from_utc_timestamp(timestamp_millis(timestamp_ms), '{zone}'))")
    return df.withColumn("block_start", block_start(F.col("timestamp_ms"), zone)).withColumn("utc_offset", offset)


def blocks(df: DataFrame, zone: str = "UTC", *more: str) -> DataFrame:
    """By five-hour block and UTC offset, with the label HH:00-HH:00."""
    rows = by(with_block(df, zone), "block_start", "utc_offset", *more)
    end = F.col("block_start") + F.expr(f"INTERVAL {BLOCK_HOURS} HOURS")
    return rows.withColumn("label", F.concat(F.date_format("block_start", "HH:mm"), F.lit("-"), F.date_format(end, "HH:mm")))


def endpoints(df: DataFrame) -> DataFrame:
    """By endpoint in canonical order."""
    return by(df, "endpoint").orderBy(endpoint_order(F.col("endpoint")))


def tool_counts(calls: DataFrame) -> DataFrame:
    """Calls by tool, most first, with the share of all."""
    counts = calls.groupBy("name").agg(F.count("*").alias("calls"))
    share = F.round(F.col("calls") * 100.0 / F.sum("calls").over(Window.partitionBy()), 1)
    return counts.withColumn("share", share).orderBy(F.desc("calls"), "name")


def top(rows: DataFrame, name: str, limit: int = 10, cost: str = "cost") -> DataFrame:
    """The first rows by cost, unknown cost last, then tokens, then name; rank and share of the rows shown.

    The share is of cost if every row shown has a known positive cost, else of tokens. rows has name, cost, tokens.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    order = [F.desc_nulls_last(cost), F.desc("tokens"), F.asc(name)]
    shown = rows.orderBy(*order).limit(limit)  # TakeOrderedAndProject: at most limit rows go on
    all_ = Window.partitionBy()
    by_cost = F.every(F.coalesce(F.col(cost) > 0, F.lit(False))).over(all_)
    basis = F.when(by_cost, F.col(cost)).otherwise(F.col("tokens").cast("double"))
    shown = shown.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("__basis", basis)
    whole = F.sum("__basis").over(all_)
    shown = shown.withColumn("share_basis", F.when(by_cost, "cost").otherwise("tokens"))
    return shown.withColumn("share", F.when(whole > 0, F.round(F.col("__basis") * 100 / whole, 2)).otherwise(0.0)).drop("__basis")


def statusline(df: DataFrame) -> DataFrame:
    """All measures of a day in one row."""
    return with_cost_parts(df).agg(*sums()).withColumn("total_tokens", total_tokens())


