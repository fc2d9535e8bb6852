"""Wire logs: sessions/<work dir>/<session>/agents/<agent>/wire.jsonl, with session_index.jsonl for work folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, work_dir_slug
from .base import Capabilities, Source, json_lines, part_from_end, usage

WIRE = "type string, model string, usage struct<inputOther:bigint,output:bigint,inputCacheRead:bigint,inputCacheCreation:bigint>, usageScope string, time bigint"
INDEX = "sessionId string, workDir string"


def scan(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """Usage records of turns; those without a time are rejected, those without tokens left out."""
    index = json_lines(spark, f"{root}/session_index.jsonl", INDEX, pattern="session_index.jsonl").where("NOT rejected AND j.sessionId IS NOT NULL").select(F.col("j.sessionId").alias("sid"), F.col("j.workDir").alias("work"), F.struct("file_path", "line_ord").alias("at"))
    work = index.groupBy("sid").agg(F.max_by("work", "at").alias("work"))  # the last line counts
    named = lambda df: df.withColumn("sid", part_from_end(F.col("file_path"), 4)).join(work, "sid", "left")
    rows = json_lines(spark, f"{root}/sessions", WIRE, pattern="wire.jsonl", needle="usage.record", beside=named)
    rows = rows.where(F.col("rejected") | ((F.col("j.type") == "usage.record") & (F.col("j.usageScope") == "turn") & F.col("j.usage").isNotNull()))
    u = F.col("j.usage")
    n = dict(input_tokens=clamp(u["inputOther"]), output_tokens=clamp(u["output"]), cache_read=clamp(u["inputCacheRead"]), cache_creation=clamp(u["inputCacheCreation"]))
    rows = rows.where(F.col("rejected") | (n["input_tokens"] + n["output_tokens"] + n["cache_read"] + n["cache_creation"] > 0))
    rows = rows.withColumn("rejected", F.col("rejected") | F.coalesce(F.col("j.time") <= 0, F.lit(True)))
    rows = rows if "sid" in rows.columns else named(rows)
    project = F.coalesce("work", work_dir_slug(part_from_end(F.col("file_path"), 5)), F.lit(""))
    return usage(
        rows, zone, source=F.lit("kimi"), timestamp_ms=F.col("j.time"), message_id=F.concat_ws(":", "file_path", "line_ord"), session_key=F.regexp_replace("file_path", "/agents/[^/]*/[^/]*$", ""),
        session_id=F.col("sid"), project_path=project, model=F.coalesce("j.model", F.lit("kimi")), stop_reason=F.lit("complete"), **n,
    )


SOURCE = Source("kimi", ("km",), Capabilities(projects=True, cache_creation=True, dedup=False), scan, "Kimi")
