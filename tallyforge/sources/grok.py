"""Inference telemetry and per-turn session files.

The unified log has a line for each inference. Session folders have per-turn usage with a map by model, or only growing
snapshots, which count where a session has no turn at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, instant_ms, local_date, percent_decoded, split_overlap
from ..operators.ordered import snapshot_tokens
from ..plans.pricing import tiered_cost
from ..schema import COLUMNS, USAGE
from ..streaming.ledgers import Ledger
from .base import Capabilities, Source, json_lines, part_from_end, text_files, usage, whole_json
from .many import Below

UNIFIED = "ts string, sid string, msg string, ctx struct<loop_index:bigint,prompt_tokens:bigint,cached_prompt_tokens:bigint,completion_tokens:bigint,reasoning_tokens:bigint>"
DONE = "shell.turn.inference_done"
SUMMARY = "created_at string, updated_at string, last_active_at string, current_model_id string, git_root_dir string"
SIGNALS = "contextTokensUsed bigint, totalTokensBeforeCompaction bigint, primaryModelId string, modelsUsed array<string>"
T = "inputTokens:bigint,outputTokens:bigint,cachedReadTokens:bigint,cacheCreationTokens:bigint,reasoningTokens:bigint,modelCalls:bigint,costUsdTicks:bigint"
UPDATE = (
    f"timestamp bigint, params struct<sessionId:string,update:struct<sessionUpdate:string,prompt_id:string,stop_reason:string,usage:struct<{T},modelUsage:map<string,struct<{T}>>>>,"
    "_meta:struct<eventId:string,agentTimestampMs:bigint,totalTokens:bigint,promptId:string,turnStartMs:bigint>>"
)
TICKS = 1e10
PARTS = ("input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning_tokens")


def session_files(spark: SparkSession, root: str) -> Below:
    """The files of session folders."""
    return Below.of(spark, f"{root}/sessions", "summary.json", "updates.jsonl", "signals.json")


def session_metadata(spark: SparkSession, root: str, below: Below | None = None) -> DataFrame:
    """session_id (folder), session_key, project_path and default model of each session."""
    rows = whole_json(spark, f"{root}/sessions", "summary.json", SUMMARY, below)
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        part_from_end(F.col("file_path"), 2).alias("sid"), folder.alias("meta_key"), F.coalesce(blank("j.git_root_dir"), percent_decoded(part_from_end(F.col("file_path"), 3)), F.lit("")).alias("meta_project"),
        F.coalesce(blank("j.current_model_id"), F.lit("grok")).alias("meta_model"), F.coalesce("j.last_active_at", "j.updated_at", "j.created_at").alias("active_at"),
    )


def unified(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """Inferences of the unified log, priced by the length of their prompts where such rates are known."""
    rows = json_lines(spark, f"{root}/logs", UNIFIED, pattern="unified.jsonl", needle=DONE)
    rows = rows.where(F.col("rejected") | (F.col("j.msg") == DONE))
    rows = rows.where(F.col("rejected") | (instant_ms(F.trim("j.ts")).isNotNull() & (F.trim("j.sid") != "") & F.col("j.ctx.prompt_tokens").isNotNull()))
    rows = rows.withColumn("sid", F.trim("j.sid")).join(session_metadata(spark, root), "sid", "left")
    c = F.col("j.ctx")
    prompt, completion = clamp(c["prompt_tokens"]), clamp(c["completion_tokens"])
    cached, reasoning = F.least(clamp(c["cached_prompt_tokens"]), prompt), F.least(clamp(c["reasoning_tokens"]), completion)
    model = F.coalesce("meta_model", F.lit("grok"))
    version = F.when(F.lower(model).contains("grok-4.6"), "4.6").when(F.lower(model).contains("grok-4.5"), "4.5")
    key = F.concat_ws(":", "sid", F.trim("j.ts"), clamp(c["loop_index"]))
    return usage(
        rows, zone, source=F.lit("grok"), timestamp=F.trim("j.ts"), message_id=key, session_key=F.coalesce("meta_key", "sid"), session_id=F.col("sid"), project_path=F.coalesce("meta_project", F.lit("")),
        model=model, input_tokens=prompt - cached, output_tokens=completion - reasoning, cache_read=cached, reasoning_tokens=reasoning, stop_reason=F.lit("complete"),
        recorded_cost_usd=tiered_cost(version, prompt, cached, completion),
    )


def _normal(v: Column) -> Column:
    """Disjoint tokens, calls and cost of a usage struct."""
    n = lambda name: clamp(v[name])
    calls = F.when(n("modelCalls") > 0, n("modelCalls")).otherwise(1)
    values = (split_overlap(n("inputTokens"), n("cachedReadTokens")), split_overlap(n("outputTokens"), n("reasoningTokens")), n("cacheCreationTokens"), n("cachedReadTokens"), n("reasoningTokens"))
    cost = F.when(v["costUsdTicks"] >= 0, v["costUsdTicks"] / TICKS)
    return F.struct(*[x.cast("long").alias(p) for x, p in zip(values, PARTS)], calls.cast("long").alias("calls"), cost.alias("cost"))


def turns(spark: SparkSession, root: str, zone: str = "UTC", below: Below | None = None) -> DataFrame:
    """Per-turn usage by model; what the models leave of the turn goes to the session's default model."""
    below = below or session_files(spark, root)
    sid, known = part_from_end(F.col("file_path"), 2).alias("sid"), session_metadata(spark, root, below).drop("active_at")
    rows = json_lines(spark, f"{root}/sessions", UPDATE, pattern="updates.jsonl", needle="turn_completed", below=below, beside=lambda files: files.select("*", sid).join(known, "sid", "left"))
    u, meta = F.col("j.params.update"), F.col("j.params._meta")
    rows = rows.where(F.col("rejected") | (u["sessionUpdate"] == "turn_completed"))
    stamp = F.col("j.timestamp")
    ms = F.coalesce(F.when(meta["agentTimestampMs"] > 0, meta["agentTimestampMs"]), F.when(stamp > 10**12, stamp).when(stamp > 0, stamp * 1000))
    rejected = F.col("rejected") | u["usage"].isNull() | ms.isNull()
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    base = F.coalesce(blank(meta["eventId"]), blank(u["prompt_id"]), F.concat(F.lit("turn:"), F.hex(F.xxhash64("value"))))
    joined = "sid" in rows.columns
    rows = rows.select(  # neither the text nor the rest of a line goes into the join
        "file_path", "line_ord", rejected.alias("rejected"), ms.alias("ms"), base.alias("base"),
        u["stop_reason"].alias("stop"), F.col("j.params.sessionId").alias("given"), F.when(~rejected, u["usage"]).alias("usage"), *(known.columns if joined else [sid]),
    )
    rows = (rows if joined else rows.join(known, "sid", "left")).withColumn("fallback", F.coalesce("meta_model", F.lit("grok")))
    v = F.col("usage")
    rows = rows.withColumn("whole", _normal(v))
    entries = F.transform(F.filter(F.map_entries(v["modelUsage"]), lambda e: F.trim(e["key"]) != ""), lambda e: F.struct(e["key"].alias("model"), _normal(e["value"]).alias("n")))
    number = f"struct<{','.join(f'{p}:bigint' for p in PARTS)},calls:bigint,cost:double>"
    rows = rows.withColumn("parts", F.coalesce(entries, F.array().cast(f"array<struct<model:string,n:{number}>>")))
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    add = lambda f, none: F.aggregate("parts", none, lambda a, e: a + F.coalesce(e["n"][f], none))
    rest = [F.greatest(F.col(f"whole.{p}") - add(p, zero), zero).alias(p) for p in (*PARTS, "calls")]
    cost = F.when(F.col("whole.cost").isNotNull(), F.greatest(F.col("whole.cost") - add("cost", nothing), nothing))
    left = F.struct(*rest, cost.alias("cost"))
    each = F.when(F.size("parts") == 0, F.array(F.struct(F.col("fallback").alias("model"), F.col("whole").alias("n")))).otherwise(F.concat("parts", F.array(F.struct(F.col("fallback").alias("model"), left.alias("n")))))
    fields = (*PARTS, "calls", "cost")
    both = lambda a, n: F.struct(*[F.coalesce(a[f] + n[f], a[f], n[f]).alias(f) for f in fields])
    of = lambda m: F.aggregate(F.filter("each", lambda e: e["model"] == m), F.lit(None).cast(number), lambda a, e: both(a, e["n"]))
    names = F.array_distinct(F.transform("each", lambda e: e["model"]))
    summed = F.transform(names, lambda m: F.struct(m.alias("model"), of(m).alias("n")))  # a line's models are summed where it is read, if one comes twice
    models = F.when(F.size(names) == F.size("each"), F.col("each")).otherwise(summed)
    keep = ["file_path", "line_ord", "rejected", "ms", "sid", "meta_key", "meta_project", "base", "stop", "given", F.col("whole.cost").alias("turn_cost")]
    told = F.when(F.col("rejected"), F.array(F.struct(F.lit(None).cast("string").alias("model"), F.lit(None).cast(number).alias("n")))).otherwise(models)
    rows = rows.withColumn("each", each).select(*keep, F.explode(told).alias("x")).select("*", "x.model", "x.n").drop("x")
    used = F.col("n.cost") > 0
    for p in PARTS:
        used = F.coalesce(used, F.lit(False)) | (F.col(f"n.{p}") > 0)
    rows = rows.where(F.col("rejected") | used | (F.col("n.calls") > 1))
    return usage(
        rows, zone, source=F.lit("grok"), timestamp_ms=F.col("ms"), message_id=F.concat_ws(":", "base", "model"), session_key=F.coalesce("meta_key", "sid"),
        session_id=F.coalesce(F.nullif(F.trim("given"), F.lit("")), F.col("sid")), project_path=F.coalesce("meta_project", F.lit("")), model=F.col("model"), stop_reason=F.col("stop"),
        call_count=F.col("n.calls"), recorded_cost_usd=F.coalesce("n.cost", F.when(F.col("turn_cost").isNotNull(), F.lit(0.0))), **{p: F.col(f"n.{p}") for p in PARTS},
    )


def snapshots(spark: SparkSession, root: str, zone: str = "UTC", below: Below | None = None) -> DataFrame:
    """Estimates of sessions without any turn, from context sizes."""
    below = below or session_files(spark, root)
    updates = json_lines(spark, f"{root}/sessions", UPDATE, pattern="updates.jsonl", below=below).where("NOT rejected")
    meta, sid = F.col("j.params._meta"), part_from_end(F.col("file_path"), 2).alias("sid")
    turn = F.coalesce(F.col("j.params.update.sessionUpdate") == "turn_completed", F.lit(False)).alias("turn")
    seen = updates.select(sid, F.coalesce(meta["promptId"], meta["turnStartMs"].cast("string")).alias("grp"), meta["totalTokens"].alias("seen"), turn).where("turn OR seen IS NOT NULL")
    seen = snapshot_tokens(seen, "sid", "grp", "seen", "turn")
    signals = whole_json(spark, f"{root}/sessions", "signals.json", SIGNALS, below).select(sid, (clamp(F.col("j.contextTokensUsed")) + clamp(F.col("j.totalTokensBeforeCompaction"))).alias("signal"), F.coalesce("j.primaryModelId", F.try_element_at("j.modelsUsed", F.lit(1))).alias("signal_model"))
    rows = session_metadata(spark, root, below).join(seen, "sid", "left").where("turn IS NULL OR NOT turn").join(signals, "sid", "left")
    tokens = F.coalesce(F.nullif(F.col("signal"), F.lit(0)), F.col("seen"))
    rows = rows.withColumn("tokens", tokens).where("tokens > 0").withColumn("rejected", instant_ms(F.col("active_at")).isNull()).withColumn("file_path", F.col("meta_key")).withColumn("line_ord", F.lit(0))
    return usage(
        rows, zone, source=F.lit("grok"), timestamp=F.col("active_at"), message_id=F.concat(F.lit("session:"), "sid"), session_key=F.col("meta_key"), session_id=F.col("sid"), project_path=F.col("meta_project"),
        model=F.coalesce("signal_model", "meta_model"), input_tokens=F.col("tokens"), stop_reason=F.lit("complete"), cost_kind=F.lit("estimated_proxy"),
    )


def durable(spark: SparkSession, root: str, ledger: str, zone: str = "UTC") -> DataFrame:
    """Inferences of the log and of all runs before, by their key; the log may be gone. A log with lines that do not parse changes nothing."""
    rows = unified(spark, root, zone)
    kept = Ledger(spark, ledger, USAGE, "message_id", "line_ord")
    if rows.where("rejected").isEmpty():
        kept.add(rows.drop("rejected"))
    return kept.read().withColumn("date", local_date(F.col("timestamp_ms"), zone))


def has_log(spark: SparkSession, root: str) -> bool:
    """Whether the unified log is there; nothing of it is read."""
    text = text_files(spark, f"{root}/logs", "unified.jsonl")
    return text is not None and bool(text.inputFiles())


def sessions(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """Turns of the session folders, and estimates of sessions without any."""
    below = session_files(spark, root)
    return turns(spark, root, zone, below).unionByName(snapshots(spark, root, zone, below))


def scan(spark: SparkSession, root: str, zone: str = "UTC", files: str = "auto", ledger: str | None = None) -> DataFrame:
    """Inferences of the unified log, or what the session folders say. files is unified, sessions or auto.

    auto takes the log if it is there, and with a ledger (a folder) what that has kept of it, this run included; a log of which nothing
    can be kept is read as it is. Without a log the ledger counts, and without either the sessions.
    """
    made = {"unified": unified, "sessions": sessions}
    if files != "auto":
        if files not in made:
            raise ValueError(f"files must be auto or one of {', '.join(made)}")
        return made[files](spark, root, zone)
    log = has_log(spark, root)
    if ledger is not None:
        kept = durable(spark, root, ledger, zone) if log else Ledger(spark, ledger, USAGE, "message_id", "line_ord").read().withColumn("date", local_date(F.col("timestamp_ms"), zone))
        if Ledger(spark, ledger, USAGE, "message_id", "line_ord").manifest().segments:
            return kept.select(*COLUMNS).withColumn("rejected", F.lit(False))
    return unified(spark, root, zone) if log else sessions(spark, root, zone)


SOURCE = Source("grok", ("gx",), Capabilities(projects=True, reasoning=True, cache_creation=True), scan, "Grok")
