"""Billing events in whole JSON documents."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, instant_ms
from . import pages
from .base import Capabilities, Source, usage, whole_text

LISTS = ("usageEventsDisplay", "usageEvents", "events")


def _number(event: Column, *paths: str) -> Column:
    read = [F.get_json_object(event, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(r.rlike(r"^-?[0-9.]+([eE][-+]?\d+)?$"), r.cast("double")) for r in read])


def _text(event: Column, *paths: str) -> Column:
    """The first that is there; a blank first one does not fall through."""
    return F.nullif(F.trim(F.coalesce(*[F.get_json_object(event, f"$.{p}") for p in paths])), F.lit(""))


def saved_pages(spark: SparkSession, root: str, zone: str, wanted: tuple) -> DataFrame:
    """Events of a crawl, which is one document; those of other days are not asked for, as the service would not give them."""
    since, until = wanted
    found = pages.events(spark, root)
    if since is not None:
        found = found.where(F.col("ms") >= _midnight_ms(since, zone))
    if until is not None and until < date.max:
        found = found.where(F.col("ms") < _midnight_ms(until + timedelta(days=1), zone))
    at = F.col("page") * (1 << 24) + F.col("pos")
    return found.select(F.lit(root).alias("file_path"), F.col("event").alias("e"), F.lit(False).alias("rejected"), at.alias("line_ord"))


def _midnight_ms(day: date, zone: str) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Events of whole documents below root; a document without a list of them is rejected."""
    text = whole_text(spark, root, "*.json")
    listed = F.coalesce(*[F.get_json_object("value", f"$.{x}") for x in LISTS], F.when(F.ltrim("value").startswith("["), F.col("value")))
    events = text.select("file_path", F.from_json(listed, "array<string>").alias("events")).where("events IS NULL OR size(events) > 0")
    rows = events.select("file_path", F.posexplode_outer("events").alias("pos", "e"))  # only a document without a list gives a row without a place
    return rows.select("file_path", "e", F.col("pos").isNull().alias("rejected"), F.coalesce(F.col("pos"), F.lit(0)).cast("long").alias("line_ord"))


def scan(spark: SparkSession, root: str, zone: str = "UTC", wanted: tuple = (None, None)) -> DataFrame:
    """Events with tokens or a charge; an id that comes again in a document counts once, the first.

    A root with saved pages of the service is one document, and of it only pages with events of the wanted days (since, until) are read.
    """
    rows = saved_pages(spark, root, zone, wanted) if pages.is_crawl(spark, root) else documents(spark, root)
    e = F.col("e")
    said = _text(e, "timestamp", "createdAt", "time")
    ms = F.coalesce(instant_ms(said), F.when(said.rlike(r"^-?\d+$"), said.cast("long")), _number(e, "timestamp", "createdAt", "unixMs", "timestampMs").cast("long"))
    rows = rows.withColumn("ms", ms)
    count = lambda *paths: clamp(F.floor(_number(e, *paths)))
    n = dict(
        input_tokens=count("tokenUsage.inputTokens", "tokenUsage.input_tokens", "tokenCount.inputTokens", "inputTokens"),
        output_tokens=count("tokenUsage.outputTokens", "tokenUsage.output_tokens", "tokenCount.outputTokens", "outputTokens"),
        cache_creation=count("tokenUsage.cacheWriteTokens", "tokenUsage.cache_write_tokens", "cacheWriteTokens"),
        cache_read=count("tokenUsage.cacheReadTokens", "tokenUsage.cache_read_tokens", "cacheReadTokens"),
    )
    cents = _number(e, "chargedCents")
    cost = F.when(cents.isNotNull(), F.greatest(cents / 100, F.lit(0.0)))
    session = F.coalesce(_text(e, "conversationId", "generationUUID", "generationId"), F.lit("unknown"))
    ident = F.coalesce(_text(e, "usageEventId", "requestId", "id", "generationUUID", "generationId"), F.col("line_ord").cast("string"))
    used = n["input_tokens"] + n["output_tokens"] + n["cache_creation"] + n["cache_read"] > 0
    rows = rows.where(F.col("rejected") | (F.col("ms").isNotNull() & (used | (F.coalesce(cost, F.lit(0.0)) > 0))))
    out = usage(
        rows, zone, source=F.lit("cursor"), timestamp_ms=F.col("ms"), message_id=F.concat(F.lit("event:"), ident), session_key=F.concat(F.lit("cursor:"), session), session_id=session,
        project_path=F.lit(""), model=F.coalesce(_text(e, "model", "modelName"), F.lit("cursor")), stop_reason=F.lit("complete"), recorded_cost_usd=cost, **n,
    )
    whole = out.select("file_path", "message_id", "rejected", "line_ord", F.struct(*out.columns).alias("__row"))  # a rejected document is one row
    return whole.groupBy("file_path", "message_id", "rejected").agg(F.min_by("__row", "line_ord").alias("__row")).select("__row.*")


SOURCE = Source("cursor", ("cur",), Capabilities(cache_creation=True, dedup=False, ranged=True), scan, "Cursor")
