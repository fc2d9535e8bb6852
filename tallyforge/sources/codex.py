"""Cumulative counter logs: <root>/sessions/**/*.jsonl, with headers, contexts and running totals in one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, instant_ms, split_overlap
from ..operators.ordered import carried_across
from ..staging import staged
from .base import Capabilities, Source, file_stem, json_lines, listing, no_path, usage
from .tails import is_link, last_limits

TOTALS = "struct<input_tokens:bigint,cached_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>"
LIMIT = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
LINE = (
    f"timestamp string, type string, payload struct<type:string,id:string,model:string,source:string,thread_source:string,"
    f"info:struct<total_token_usage:{TOTALS},last_token_usage:{TOTALS},model:string,model_name:string,metadata:struct<model:string>>,"
    f"rate_limits:struct<primary:{LIMIT},secondary:{LIMIT}>>"
)
FIELDS = ("input", "cached", "output", "reasoning", "total")
SCOPES = ("all", "interactive", "exec", "subagent")
WEEK_MINUTES = 10080
MARGIN_MINUTES = 24 * 60
DEFAULT_MODEL = "gpt-5"


def _vector(totals: Column) -> Column:
    n = lambda *names: F.coalesce(*[totals[x] for x in names], F.lit(0)).cast("long")
    values = (n("input_tokens"), n("cached_input_tokens", "cache_read_input_tokens"), n("output_tokens"), n("reasoning_output_tokens"), n("total_tokens"))
    return F.struct(*[v.alias(f) for v, f in zip(values, FIELDS)])


def origin(payload: Column, text: Column) -> Column:
    """Who started a session: a source that is a string or an object, sub-agents first; null if unknown."""
    word = F.lower(F.trim(payload["source"]))
    has = lambda k: F.get_json_object(text, f"$.payload.source.{k}").isNotNull()
    return (
        F.when(F.lower(payload["thread_source"]) == "subagent", "subagent")
        .when(word.isin("cli", "interactive"), "interactive").when(word.isin("exec", "subagent"), word)
        .when(has("subagent"), "subagent").when(has("exec"), "exec").when(has("cli"), "interactive")
    )


def splits_files(spark: SparkSession, path: str) -> bool:
    """Whether Spark may read a file below path in more than one part. Files up to the cost of opening one are always whole."""
    files = session_files(spark, path)
    if files is None:
        return False
    size = lambda name: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    whole = min(size("spark.sql.files.maxPartitionBytes"), size("spark.sql.files.openCostInBytes"))
    return (files.agg(F.max("length")).first()[0] or 0) > whole


def scan(spark: SparkSession, root: str, zone: str = "UTC", scope: str = "all", missing_model: str = DEFAULT_MODEL) -> DataFrame:
    """Accepted growth of the totals, with the model, session and origin that hold at that line.

    A line's state depends on all lines of its file before it. Small files are one window each; if any is read in parts, the lines that carry state or usage are
    staged, and state is carried through the parts and then across them (carried_across), so that one long file keeps all cores busy.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    rows = json_lines(spark, f"{root}/sessions", LINE)
    p = F.col("j.payload")
    meta, context = F.col("j.type") == "session_meta", F.col("j.type") == "turn_context"
    event = (F.col("j.type") == "event_msg") & (p["type"] == "token_count")
    # Only lines that carry state or usage go on, without their text.
    rows = rows.where(F.col("rejected") | F.coalesce(meta | context | event, F.lit(False)))
    usage_ = event & F.col("j.timestamp").isNotNull() & p["info"]["total_token_usage"].isNotNull() & ~F.col("rejected")
    last = p["info"]["last_token_usage"]
    named = F.coalesce(*[blank_to_null(x) for x in (p["info"]["model"], p["info"]["model_name"], p["info"]["metadata"]["model"], p["model"])])
    rows = rows.select(
        "file_path", "part", "line_ord", "rejected", F.col("j.timestamp").alias("timestamp"), F.coalesce(context, F.lit(False)).alias("context"), F.coalesce(usage_, F.lit(False)).alias("counts"),
        F.when(meta, F.struct(origin(p, F.col("value")).alias("o"))).alias("head"), F.when(meta, blank_to_null(p["id"])).alias("ident"),
        F.when(usage_, _vector(p["info"]["total_token_usage"])).alias("total"), F.when(last.isNotNull(), _vector(last)).alias("last"), named.alias("named"),
    )
    part = "part" if splits_files(spark, f"{root}/sessions") else None
    if part is not None:
        rows = staged(rows, "counter-lines")
    carry = lambda df, **values: carried_across(df, values, "file_path", "line_ord", part)
    if scope == "all":
        rows = carry(rows, logical=(F.col("ident"), 0), before=(F.col("total"), -1))
    else:
        rows = carry(rows, said=(F.col("head"), 0), logical=(F.col("ident"), 0))
        wanted = F.coalesce(F.col("said.o") == scope, F.lit(False))
        rows = rows.withColumn("counts", F.col("counts") & wanted).withColumn("total", F.when(F.col("counts"), F.col("total")))
        rows = carry(rows if part is None else staged(rows, "counter-scope"), before=(F.col("total"), -1))
    rows = rows.withColumnRenamed("total", "now")
    grown = F.struct(*[F.greatest(F.col(f"now.{f}") - F.coalesce(F.col(f"before.{f}"), F.lit(0)), F.lit(0)).alias(f) for f in FIELDS])
    rows = rows.withColumn("delta", F.when(F.col("last").isNotNull(), F.col("last")).otherwise(grown))
    some = F.col("delta.input") + F.col("delta.cached") + F.col("delta.output") + F.col("delta.reasoning") != 0
    changed = F.col("counts") & ~F.col("now").eqNullSafe(F.col("before")) & some
    rows = rows.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("stamp", instant_ms(F.col("timestamp")))
    accepted = F.col("changed") & F.col("stamp").isNotNull()
    rows = carry(rows, model=(F.when(F.col("context") | accepted, F.col("named")), 0)).withColumn("model", F.coalesce("model", F.lit(missing_model)))
    rows = rows.where(F.col("rejected") | F.col("changed")).withColumn("rejected", F.col("rejected") | F.col("stamp").isNull())
    logical = F.coalesce(F.concat(F.lit("codex-session:"), "logical"), F.col("file_path"))
    numbers = [F.col(f"{s}.{f}").cast("string") for s in ("now", "delta") for f in FIELDS]
    prefix = F.when(F.col("now") == F.col("delta"), "codex-token-count").otherwise("source-wide:codex-token-count")
    cached = F.least("delta.cached", "delta.input")
    return usage(
        rows, zone, source=F.lit("codex"), timestamp=F.col("timestamp"), message_id=F.concat_ws(":", prefix, logical, "model", *numbers),
        session_key=logical, session_id=file_stem(F.col("file_path")), project_path=F.lit(""), model=F.col("model"),
        input_tokens=split_overlap(F.col("delta.input"), F.col("delta.cached")), output_tokens=split_overlap(F.col("delta.output"), F.col("delta.reasoning")),
        cache_read=cached, reasoning_tokens=F.least("delta.reasoning", "delta.output"), stop_reason=F.lit("complete"),
    )


def session_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length, modificationTime) of the session files below path, of which nothing is read; null without a folder."""
    try:
        with listing(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path)
    except Exception as e:
        if not no_path(e):
            raise
        return None
    return files.select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime")


def recent_files(files: DataFrame, now_s: int) -> DataFrame:
    """Session files that may hold the running week: by the date in their path or by their last change."""
    since = F.timestamp_seconds(F.lit(now_s - (WEEK_MINUTES + MARGIN_MINUTES) * 60))
    day = F.try_to_date(F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/[^/]*$", 1), "yyyy/MM/dd")
    return files.where((day >= F.to_date(since)) | (F.col("modificationTime") >= since))


QUOTA = "used_percent double, window_minutes long, resets_at long, observed_at long, file_path string, error string"


def quota_snapshot(spark: SparkSession, root: str, now_s: int | None = None) -> DataFrame:
    """The newest weekly rate limit in one row: of each file its last one, of those the latest; the first file wins ties.

    Each file is read from its end, as far as its last weekly limit. error tells why there is none: sessions_not_found, sessions_is_a_link,
    snapshot_not_found, malformed_line (one after a file's last weekly limit, or the limit itself; a last line that breaks off without a
    line end is still being written and does not count) or invalid_percent. With now_s only recent files are read.
    """
    none = lambda error: spark.createDataFrame([(None,) * 5 + (error,)], QUOTA)
    if is_link(f"{root}/sessions"):
        return none("sessions_is_a_link")
    files = session_files(spark, f"{root}/sessions")
    if files is None:
        return none("sessions_not_found")
    found = last_limits(files if now_s is None else recent_files(files, now_s), WEEK_MINUTES)
    problem = F.when(F.max(F.col("problem") == "malformed_line").over(Window.partitionBy()), "malformed_line")  # a row for each file
    problem = F.coalesce(problem, F.when(F.max(F.col("problem") == "invalid_percent").over(Window.partitionBy()), "invalid_percent"))
    best = found.withColumn("error", problem).where("ms IS NOT NULL OR problem IS NOT NULL").orderBy(F.desc_nulls_last("ms"), "file_path").limit(1)
    best = best.select("used_percent", "window_minutes", "resets_at", F.floor(F.col("ms") / 1000).alias("observed_at"), "file_path", "error")
    return best.unionByName(none("snapshot_not_found")).orderBy(F.coalesce(F.col("error") == "snapshot_not_found", F.lit(False))).limit(1)


SOURCE = Source("codex", ("cx",), Capabilities(quota=True, reasoning=True), scan, "Codex")
