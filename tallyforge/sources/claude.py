"""Streamed message logs: <root>/projects/<project>/**/<session>.jsonl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, endpoint, instant_ms, local_date, model_name
from .base import Capabilities, Source, file_stem, json_lines, part_from_end, usage

LINE = (
    "timestamp string, message struct<id:string,model:string,stop_reason:string,usage:struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation:struct<ephemeral_1h_input_tokens:bigint>,inference_geo:string>>"
)
CONTENT = "array<struct<type:string,name:string,id:string>>"


def project(path):
    """The component after the first one named projects, else the parent folder."""
    found = F.regexp_extract(path, "^.*?/projects/([^/]+)/", 1)
    return F.coalesce(F.nullif(found, F.lit("")), part_from_end(path, 2), F.lit("unknown"))


def scan(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """Messages with usage; synthetic ones are left out, timestamps that do not parse reject a line."""
    rows = json_lines(spark, f"{root}/projects", LINE)
    rows = rows.where(F.col("rejected") | (F.col("j.timestamp").isNotNull() & F.col("j.message.usage").isNotNull()))
    rows = rows.where(F.col("rejected") | F.coalesce(~F.trim("j.message.model").isin("<synthetic>", ""), F.lit(True)))
    rows = rows.withColumn("rejected", F.col("rejected") | instant_ms(F.col("j.timestamp")).isNull())
    u, m = F.col("j.message.usage"), F.col("j.message")
    created = clamp(u["cache_creation_input_tokens"])
    wide = F.when(m["id"].isNotNull(), F.concat(F.lit("source-wide:claude:"), m["id"]))
    return usage(
        rows, zone, source=F.lit("claude"), timestamp=F.col("j.timestamp"), message_id=wide, dedup_scope=F.lit(""), session_key=F.col("file_path"),
        session_id=file_stem(F.col("file_path")), project_path=project(F.col("file_path")), model=F.coalesce(model_name(F.trim(m["model"])), F.lit("unknown")),
        input_tokens=clamp(u["input_tokens"]), output_tokens=clamp(u["output_tokens"]), cache_creation=created,
        cache_creation_1h=F.least(clamp(u["cache_creation"]["ephemeral_1h_input_tokens"]), created), cache_read=clamp(u["cache_read_input_tokens"]),
        stop_reason=m["stop_reason"], endpoint=endpoint(u["inference_geo"]),
    )


def tool_calls(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """Tool calls of both places where messages are kept; lines that do not parse are skipped."""
    text = json_lines(spark, f"{root}/projects", "timestamp string", needle='"tool_use"')
    at = lambda p: F.get_json_object("value", p)
    blocks = F.concat(*[F.coalesce(F.from_json(at(p), CONTENT), F.array().cast(CONTENT)) for p in ("$.message.content", "$.data.message.message.content")])
    stamp = F.coalesce(at("$.timestamp"), at("$.data.message.timestamp"))
    ident = F.coalesce(at("$.message.id"), at("$.data.message.message.id"), at("$.data.message.id"))
    calls = text.select(stamp.alias("t"), ident.alias("message_id"), F.col("file_path").alias("session_key"), F.explode(blocks).alias("b")).where("b.type = 'tool_use' AND b.name IS NOT NULL")
    return calls.select(F.lit("claude").alias("source"), "b.name", local_date(instant_ms(F.col("t")), zone).alias("date"), "session_key", "message_id", F.col("b.id").alias("tool_use_id"))


SOURCE = Source("claude", ("cc",), Capabilities(projects=True, blocks=True, endpoints=True, tools=True, cache_creation=True), scan, "Claude Code")
