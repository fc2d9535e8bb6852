"""Queries over the driver's tables, one or more for each operator, each beside its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import measures as M
from .functions import scalars as S
from .operators import dedup, ordered, reports
from .operators.intervals import Cuts
from .plans import forecast, pricing
from .plans.ledger import LEDGER_SQL, PRICES, events_ledger, price_table
from .schema import RATES, TOKENS
from .staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def day():
    """The date as text."""
    return F.col("date").cast("string").alias("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What sums by model need of a fact.
MEASURED = ("model", *TOKENS, "call_count", "cost_kind", "recorded_cost_usd")


def facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Deduplicated usage facts: these columns of them, or all."""
    ledger = events_ledger(spark, sf_dir)
    return dedup.best_candidate(ledger.select(*dict.fromkeys((*dedup.IDENTITY, *columns))) if columns else ledger)


# Parts of the DuckDB counterparts.
_STATS = ", ".join(
    [f"CASE WHEN cost_kind <> 'estimated_proxy' AND recorded_cost_usd IS NOT NULL THEN 0 ELSE {t} END AS priced_{t}" for t in TOKENS]
    + [f"CASE WHEN cost_kind = 'estimated_proxy' THEN {t} ELSE 0 END AS est_{t}" for t in TOKENS]
    + [
        "CASE WHEN cost_kind <> 'estimated_proxy' AND recorded_cost_usd IS NOT NULL THEN greatest(recorded_cost_usd, 0) ELSE 0 END AS recorded_usd",
        "CASE WHEN cost_kind <> 'estimated_proxy' AND recorded_cost_usd IS NOT NULL THEN 1 ELSE 0 END AS recorded_entries",
        "CASE WHEN cost_kind = 'estimated_proxy' THEN 1 ELSE 0 END AS proxy_entries, CASE WHEN cost_kind = 'estimated_proxy' THEN 0 ELSE 1 END AS real_entries",
    ]
)
_MEASURES = [*TOKENS, "call_count", *(f"priced_{t}" for t in TOKENS), *(f"est_{t}" for t in TOKENS), "recorded_entries", "proxy_entries", "real_entries"]
_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in _MEASURES) + ", sum(recorded_usd) AS recorded_usd"
_TOTAL = "input_tokens + output_tokens + cache_creation + cache_read + reasoning_tokens"
_PTOTAL = "priced_input_tokens + priced_output_tokens + priced_cache_creation + priced_cache_read + priced_reasoning_tokens"
_KIND = "CASE WHEN proxy_entries > 0 AND real_entries > 0 THEN 'mixed' WHEN proxy_entries > 0 THEN 'estimated_proxy' ELSE 'real' END"
_HIT = "CASE WHEN input_tokens + cache_creation + cache_read > 0 THEN round(cache_read * 100.0::DOUBLE / (input_tokens + cache_creation + cache_read), 6) END"
_VALUES = ", ".join(f"({', '.join(repr(x) if isinstance(x, str) else f'{x!r}::DOUBLE' for x in p)})" for p in PRICES)


def _with(*ctes: str) -> str:
    return "WITH " + ",".join([LEDGER_SQL, f"stats AS (SELECT *, {_STATS} FROM deduped)", *ctes])


_DAILY = f"daily AS (SELECT date, model, {_SUMS} FROM stats GROUP BY date, model)"
_DOT = "regexp_replace({}, '([0-9])p([0-9])', '\\1.\\2', 'g')"
_PLAIN = "regexp_replace(regexp_replace({}, '^anthropic\\.', ''), '^claude-', '')"
_CANON = "regexp_replace(regexp_replace(regexp_replace(lower({}), '^(anthropic\\.|anthropic/|openai/|xai/)', ''), '^anthropic\\.', ''), '^claude-', '')"
_FAMILY = "regexp_matches({}, '(^|[-./_])(sonnet|opus|haiku)($|[-./_])')"


def _dotted(name: str, source: str) -> str:
    return f"{name} AS (SELECT model, k FROM ({source}) WHERE k <> '' UNION SELECT model, {_DOT.format('k')} FROM ({source}) WHERE k <> '')"


_RESOLVE = ",".join(
    [
        f"prices(price_key, {', '.join(RATES)}) AS (VALUES {_VALUES})",
        "asked AS (SELECT DISTINCT model FROM ledger)",
        _dotted("k0", "SELECT model, model AS k FROM asked UNION SELECT model, lower(model) FROM asked"),
        _dotted("k1", "SELECT * FROM k0 UNION SELECT model, regexp_replace(k, '^(anthropic\\.|anthropic/|openai/|xai/)', '') FROM k0"),
        _dotted("k2", "SELECT * FROM k1 UNION SELECT model, regexp_replace(k, '^claude-', '') FROM k1"),
        _dotted(
            "k3",
            f"SELECT * FROM k2 UNION SELECT model, 'claude-' || k FROM k2 WHERE NOT contains(k, '/') AND {_FAMILY.format('k')} AND NOT starts_with(k, 'claude-') "
            "UNION SELECT model, 'openai/' || k FROM k2 WHERE starts_with(k, 'gpt-') OR starts_with(k, 'codex') UNION SELECT model, 'xai/' || k FROM k2 WHERE starts_with(k, 'grok-')",
        ),
        _dotted("k4", "SELECT model, regexp_extract(k, '^(.+)-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', 1) AS k FROM k1"),
        f"tried AS (SELECT DISTINCT model, 1 AS stage, k, lower(k) AS canonical FROM (SELECT model, model AS k FROM asked UNION SELECT model, lower(model) FROM asked) "
        f"UNION SELECT model, 2, k, {_CANON.format('k')} FROM k3 UNION SELECT model, 3, k, {_CANON.format('k')} FROM k4)",
        f"bases AS (SELECT DISTINCT model, base FROM (SELECT model, {_PLAIN.format('k')} AS base FROM k3 WHERE k = lower(k)) WHERE {_FAMILY.format('base')} AND NOT regexp_matches(base, '-[0-9]{{8}}$'))",
        f"hits AS (SELECT model, stage, price_key, canonical, {', '.join(RATES)} FROM tried JOIN prices ON k = price_key "
        f"UNION ALL SELECT model, 4, price_key, {_PLAIN.format('lower(price_key)')}, {', '.join(RATES)} FROM bases JOIN prices ON regexp_extract({_PLAIN.format('lower(price_key)')}, '^(.+)-[0-9]{{8}}$', 1) = base)",
        f"told AS (SELECT model, stage, count(DISTINCT canonical) AS nc, count(DISTINCT ({', '.join(RATES)})) AS nr, min(price_key) AS matched, {', '.join(f'min({r}) AS {r}' for r in RATES)} FROM hits GROUP BY model, stage)",
        "firsts AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY model ORDER BY stage) = 1)",
        f"resolved AS (SELECT model, stage, CASE WHEN nc = 1 AND nr = 1 THEN matched END AS matched, {', '.join(f'CASE WHEN nc = 1 AND nr = 1 THEN {r} END AS r_{r}' for r in RATES)} FROM asked LEFT JOIN firsts USING (model))",
    ]
)


def _cost(prefix: str) -> str:
    t = lambda n: prefix + n
    hour = f"least({t('cache_creation_1h')}, {t('cache_creation')})"
    return (
        f"CASE WHEN {t('input_tokens')} + {t('output_tokens')} + {t('cache_creation')} + {t('cache_read')} + {t('reasoning_tokens')} = 0 THEN 0 ELSE "
        f"{t('input_tokens')} * r_input + {t('output_tokens')} * r_output + {t('reasoning_tokens')} * r_reasoning_output + ({t('cache_creation')} - {hour}) * r_cache_create + {hour} * r_cache_create_1h + {t('cache_read')} * r_cache_read END"
    )


_COSTED = (
    "costed AS (SELECT *, CASE WHEN p IS NOT NULL THEN recorded_usd + p WHEN " + _PTOTAL + " > 0 AND recorded_usd = 0 THEN NULL ELSE recorded_usd END AS cost "
    f"FROM (SELECT *, {_cost('priced_')} AS p FROM daily LEFT JOIN resolved USING (model)))"
)
_HAS = f"({_PTOTAL} > 0 OR recorded_entries > 0 OR recorded_usd > 0)"
_KNOWN = f"CASE WHEN count(*) FILTER ({_HAS}) = 0 THEN 0 ELSE sum(cost) FILTER ({_HAS}) END"


def costed_days(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    """Daily sums by model with their costs."""
    return pricing.costed(reports.daily(facts(spark, sf_dir, *MEASURED, "date")), price_table(spark), strict)


def shown(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and the measures that every report shows."""
    keys = [F.col(k).cast("string").alias(k) if k in ("date", "week") else F.col(k) for k in keys]
    return df.select(*keys, *TOKENS, "call_count", M.total_tokens().alias("total_tokens"), F.round(M.hit_rate(), 6).alias("hit_rate"), M.cost_kind().alias("cost_kind"))


_SHOWN = f"{', '.join(TOKENS)}, call_count, {_TOTAL} AS total_tokens, {_HIT} AS hit_rate, {_KIND} AS cost_kind"


@query(_with(_DAILY) + f" SELECT CAST(date AS VARCHAR) AS date, model, {_SHOWN} FROM daily")
def daily_model_usage(spark, sf_dir):
    """Daily report by model."""
    return shown(reports.daily(facts(spark, sf_dir, *MEASURED, "date")), "date", "model")


@query(_with(_DAILY) + f", r AS (SELECT date, model, {_SUMS}, grouping(date) * 2 + grouping(model) AS level FROM daily GROUP BY ROLLUP (date, model)) SELECT CAST(date AS VARCHAR) AS date, model, level, {_SHOWN} FROM r")
def daily_rollup(spark, sf_dir):
    """Daily report with a row for each day and a total row."""
    return shown(reports.with_total(reports.daily(facts(spark, sf_dir, *MEASURED, "date")), "date").withColumn("level", F.col("level").cast("int")), "date", "model", "level")


@query(_with(_DAILY) + f", r AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, model, {_SUMS} FROM daily GROUP BY ALL) SELECT CAST(week AS VARCHAR) AS week, model, {_SHOWN} FROM r")
def weekly_usage(spark, sf_dir):
    """Weeks from Monday."""
    return shown(reports.weekly(reports.daily(facts(spark, sf_dir, *MEASURED, "date"))), "week", "model")


@query(_with(_DAILY) + f", r AS (SELECT strftime(date, '%Y-%m') AS month, model, {_SUMS} FROM daily GROUP BY ALL) SELECT month, model, {_SHOWN} FROM r")
def monthly_usage(spark, sf_dir):
    """Months."""
    return shown(reports.monthly(reports.daily(facts(spark, sf_dir, *MEASURED, "date"))), "month", "model")


_SESSIONS = (
    "sessions AS (SELECT session_key, arg_min(session_id, (file_path, line_ord)) AS session_id, arg_min(project_path, (file_path, line_ord)) AS project_path, "
    "arg_min(timestamp, (timestamp_ms, file_path, line_ord)) AS first_timestamp, arg_max(timestamp, (timestamp_ms, file_path, line_ord)) AS last_timestamp, "
    f"min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, {_SUMS} FROM stats GROUP BY session_key)"
)


@query(_with(_SESSIONS) + f" SELECT session_key, session_id, project_path, first_timestamp, last_timestamp, {_SHOWN} FROM sessions")
def session_usage(spark, sf_dir):
    """Sessions with their span and project."""
    return shown(reports.sessions(facts(spark, sf_dir, *MEASURED, "session_id", "project_path", "timestamp")), "session_key", "session_id", "project_path", "first_timestamp", "last_timestamp")


@query(_with(_SESSIONS) + f", r AS (SELECT project_path, count(*) AS session_count, {_SUMS} FROM sessions GROUP BY project_path) SELECT project_path, CASE WHEN contains(project_path, '/') THEN regexp_extract(project_path, '([^/]*)$', 1) ELSE ltrim(project_path, '-') END AS project, session_count, {_SHOWN} FROM r")
def project_usage(spark, sf_dir):
    """Projects of sessions, with display names."""
    rows = reports.projects(reports.sessions(facts(spark, sf_dir, *MEASURED, "session_id", "project_path", "timestamp")))
    return shown(rows.withColumn("project", S.project_name(F.col("project_path"))), "project_path", "project", "session_count")


@query(
    _with(f"r AS (SELECT date_trunc('day', make_timestamp(timestamp_ms * 1000)) + to_hours(CAST(hour(make_timestamp(timestamp_ms * 1000)) // 5 * 5 AS INT)) AS block_start, {_SUMS} FROM stats GROUP BY ALL)")
    + f" SELECT strftime(block_start, '%Y-%m-%d %H:%M') AS block_start, strftime(block_start, '%H:%M') || '-' || strftime(block_start + INTERVAL 5 HOURS, '%H:%M') AS label, {_SHOWN} FROM r"
)
def blocks_5h(spark, sf_dir):
    """Five-hour blocks of each day."""
    return shown(reports.blocks(facts(spark, sf_dir, *MEASURED)).withColumn("block_start", F.date_format("block_start", "yyyy-MM-dd HH:mm")), "block_start", "label")


@query(_with(f"r AS (SELECT endpoint, {_SUMS} FROM stats GROUP BY endpoint)") + f" SELECT endpoint, CASE WHEN call_count <= 0 THEN 0 ELSE input_tokens // call_count END AS average_input, {_SHOWN} FROM r")
def endpoint_usage(spark, sf_dir):
    """Endpoints with whole average input for a call."""
    rows = reports.endpoints(facts(spark, sf_dir, *MEASURED, "endpoint"))
    return shown(rows.withColumn("average_input", S.average_input(F.col("input_tokens"), F.col("call_count"))), "endpoint", "average_input")


@query(
    "WITH calls AS (SELECT role AS name, conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn // 2 END AS id FROM conversations), "
    "d AS (SELECT DISTINCT name, conv_id, id, turn // 4 AS q FROM calls WHERE id IS NOT NULL), f AS (SELECT name, conv_id, id, q FROM d QUALIFY row_number() OVER (PARTITION BY conv_id, q, id ORDER BY name) = 1), "
    "n AS (SELECT name, count(*) AS calls FROM (SELECT name FROM f UNION ALL SELECT name FROM calls WHERE id IS NULL) GROUP BY name) "
    "SELECT name, calls, round(calls * 100.0::DOUBLE / sum(calls) OVER (), 1) AS share FROM n"
)
def tool_counts(spark, sf_dir):
    """Distinct tool calls by name; calls without an identity all count."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("name"), F.col("conv_id").cast("string").alias("session_key"), F.floor(F.col("turn") / 4).cast("string").alias("message_id"),
        F.when(F.col("turn") % 3 != 0, F.floor(F.col("turn") / 2).cast("string")).alias("tool_use_id"),
    )
    return reports.tool_counts(dedup.distinct_tool_calls(rows))


@query(_with() + " SELECT scope, message_id, session_key, timestamp_ms, stop_reason, line_ord FROM deduped")
def dedup_best_candidate(spark, sf_dir):
    """The winners of deduplication."""
    return facts(spark, sf_dir, *dedup.IDENTITY).select(dedup.scope().alias("scope"), "message_id", "session_key", "timestamp_ms", "stop_reason", "line_ord")


@query(_with() + " SELECT (SELECT count(*) FROM deduped) AS valid, CAST((SELECT count(message_id) - count(DISTINCT (scope, message_id)) FILTER (message_id IS NOT NULL) FROM keyed) AS BIGINT) AS dedup_skipped")
def dedup_quality(spark, sf_dir):
    """How many rows count and how many were duplicates."""
    best = dedup.counted(events_ledger(spark, sf_dir).select(*dedup.IDENTITY))
    return dedup.quality_of(best).select("valid", "dedup_skipped")


@query(_with() + " SELECT starts_with(message_id, 'source-wide:') AS source_wide, count(*) AS messages, count(DISTINCT session_key) AS sessions FROM deduped WHERE message_id IS NOT NULL GROUP BY 1")
def source_wide_vs_scoped_dedup(spark, sf_dir):
    """Messages whose ids are unique in a source, and others."""
    rows = facts(spark, sf_dir, *dedup.IDENTITY).where("message_id IS NOT NULL")
    return rows.groupBy(F.col("message_id").startswith(dedup.SOURCE_WIDE).alias("source_wide")).agg(F.count("*").alias("messages"), F.count_distinct("session_key").alias("sessions"))


@query(_with() + " SELECT DISTINCT model, regexp_replace(regexp_replace(regexp_replace(model, '^anthropic\\.', ''), '^claude-', ''), '-[0-9]{8}$', '') AS plain FROM ledger")
def model_name_normalize(spark, sf_dir):
    """Model names without prefixes and dates."""
    return events_ledger(spark, sf_dir).select("model").distinct().select("model", S.model_name(F.col("model")).alias("plain"))


@query("SELECT c_custkey, CASE WHEN contains(p, '/') OR contains(p, '\\') THEN regexp_extract(regexp_replace(p, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1) ELSE ltrim(p, '-') END AS project FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '--x-' || c_name WHEN 1 THEN '/a/' || c_name || '/' WHEN 2 THEN 'C:\\b\\' || c_name ELSE c_name END AS p FROM customer)")
def project_name_format(spark, sf_dir):
    """Display names of project paths of all kinds."""
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    path = F.when(k == 0, F.concat(F.lit("--x-"), name)).when(k == 1, F.concat(F.lit("/a/"), name, F.lit("/"))).when(k == 2, F.concat(F.lit("C:\\b\\"), name)).otherwise(name)
    return table(spark, sf_dir, "customer").select("c_custkey", S.project_name(path).alias("project"))


@query("SELECT c_custkey, CASE WHEN i + c + r > 0 THEN round(r * 100.0::DOUBLE / (i + c + r), 6) END AS rate FROM (SELECT c_custkey, greatest(CAST(floor(c_acctbal) AS BIGINT), 0) AS i, c_custkey % 3 * 0 AS c, c_custkey % 5 AS r FROM customer)")
def cache_hit_rate(spark, sf_dir):
    """Hit rates with negative and zero counts."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("cache_creation"), (F.col("c_custkey") % 5).alias("cache_read"))
    return rows.select("c_custkey", F.round(M.hit_rate(), 6).alias("rate"))


@query("SELECT l_returnflag, CAST(sum(greatest(q - d, 0)) AS BIGINT) AS outside, CAST(sum(greatest(q, 0)) AS BIGINT) AS clamped FROM (SELECT l_returnflag, CAST(floor(l_quantity) AS BIGINT) - 10 AS q, CAST(l_linenumber AS BIGINT) * 4 AS d FROM lineitem) GROUP BY 1")
def token_split_clamp(spark, sf_dir):
    """Overlapping counts made disjoint, negatives clamped."""
    q, d = F.floor("l_quantity").cast("long") - 10, F.col("l_linenumber").cast("long") * 4
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(S.split_overlap(q, d)).alias("outside"), F.sum(S.clamp(q)).alias("clamped"))


@query("WITH " + LEDGER_SQL.replace("FROM ledger", "FROM ledger WHERE date >= DATE '2024-01-20'") + " SELECT CAST(date AS VARCHAR) AS date, count(*) AS entries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM deduped GROUP BY date")
def date_filter_open_ended(spark, sf_dir):
    """Dates from a day on, filtered before dedup."""
    rows = dedup.best_candidate(reports.in_range(events_ledger(spark, sf_dir).select(*dedup.IDENTITY, "date", "input_tokens"), since="2024-01-20"))
    return rows.groupBy(day()).agg(F.count("*").alias("entries"), F.sum("input_tokens").alias("input_tokens"))


@query(
    _with(
        f"joined AS (SELECT date, model, {', '.join(TOKENS)}, call_count FROM deduped UNION ALL SELECT CAST(l_shipdate AS DATE), 'supplier-' || l_suppkey % 5, CAST(floor(l_quantity) AS BIGINT), CAST(l_linenumber AS BIGINT), 0, 0, 0, 0, 1 FROM lineitem)"
    )
    + f" SELECT model, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in (*TOKENS, 'call_count'))} FROM joined GROUP BY model"
)
def all_sources_union(spark, sf_dir):
    """Two sources, each deduplicated by its own rule, in one report."""
    zero = F.lit(0).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), F.concat(F.lit("supplier-"), F.col("l_suppkey") % 5).alias("model"), F.floor("l_quantity").cast("long").alias("input_tokens"),
        F.col("l_linenumber").cast("long").alias("output_tokens"), *[zero.alias(t) for t in TOKENS[2:]], F.lit(1).cast("long").alias("call_count"),
    )
    rows = facts(spark, sf_dir).select(*lines.columns).unionByName(lines)
    return rows.groupBy("model").agg(*[F.sum(t).alias(t) for t in (*TOKENS, "call_count")])


_RANGES = "(VALUES ('a', DATE '2024-01-01', DATE '2024-01-07'), ('b', DATE '2024-01-05', NULL), ('c', NULL, DATE '2024-01-10'), ('d', DATE '2024-01-09', DATE '2024-01-09')) w(range_id, since, until)"


@query(
    "WITH " + LEDGER_SQL.split(", keyed AS")[0] + f", keyed AS (SELECT range_id, ledger.*, CASE WHEN message_id LIKE 'source-wide:%' THEN '' ELSE session_key END AS scope FROM ledger JOIN {_RANGES} ON date >= coalesce(since, DATE '0001-01-01') AND date <= coalesce(until, DATE '9999-12-31')), "
    "deduped AS (SELECT * FROM keyed WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY range_id, scope, message_id ORDER BY stop_reason IS NULL, timestamp_ms DESC, file_path, line_ord) = 1 UNION ALL SELECT * FROM keyed WHERE message_id IS NULL AND stop_reason IS NOT NULL) "
    "SELECT range_id, model, count(*) AS entries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM deduped GROUP BY ALL"
)
def multi_range_batch(spark, sf_dir):
    """Several date ranges from one scan, each deduplicated by itself."""
    from datetime import date

    at = lambda n: date(2024, 1, n)
    cuts = Cuts([("a", at(1), at(7)), ("b", at(5), None), ("c", None, at(10)), ("d", at(9), at(9))])
    rows = events_ledger(spark, sf_dir).select(*dict.fromkeys((*dedup.IDENTITY, "date", *MEASURED)), F.lit(False).alias("rejected"))
    told, _ = cuts.merged(staged(cuts.sums(rows, MEASURED), "ranges"))
    return told.select("range_id", "model", "entries", "input_tokens")


_COUNTERS = (
    "WITH c AS (SELECT user_id, event_id, event_type, sum(CAST(floor(value) AS BIGINT)) OVER w AS total, sum(event_id % 3) OVER w AS other FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), "
    "e AS (SELECT user_id, event_id, event_type, CAST(CASE WHEN event_id % 7 = 0 THEN total // 2 ELSE total END AS BIGINT) AS total, CAST(other AS BIGINT) AS other FROM c), "
    "d AS (SELECT *, lag(total) OVER w AS bt, lag(other) OVER w AS bo, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "accepted AS (SELECT user_id, event_id, event_type, greatest(total - coalesce(bt, 0), 0) AS delta_total, greatest(other - coalesce(bo, 0), 0) AS delta_other FROM d WHERE (n = 1 OR total <> bt OR other <> bo) AND (greatest(total - coalesce(bt, 0), 0) <> 0 OR greatest(other - coalesce(bo, 0), 0) <> 0))"
)


def counters(spark, sf_dir) -> DataFrame:
    """Running totals of each user, some of which fall back."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.sum(F.floor("value").cast("long")).over(w).alias("total"), F.sum(F.col("event_id") % 3).over(w).alias("other"))
    return rows.withColumn("total", F.when(F.col("event_id") % 7 == 0, F.floor(F.col("total") / 2).cast("long")).otherwise(F.col("total")))


@query(_COUNTERS + " SELECT user_id, event_id, delta_total, delta_other FROM accepted")
def cumulative_delta(spark, sf_dir):
    """Growth of running totals, repeats and resets included."""
    rows = ordered.cumulative_delta(counters(spark, sf_dir), ["user_id"], ["event_id"], ["total", "other"])
    return rows.select("user_id", "event_id", "delta_total", "delta_other")


@query("SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN 'm' || event_id % 9 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'gpt-5') AS model FROM events")
def carry_forward_model(spark, sf_dir):
    """The model named last, or the default."""
    named = F.when(F.col("event_type") == "view", F.concat(F.lit("m"), F.col("event_id") % 9))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(ordered.carried(named, ["user_id"], ["event_id"]), F.lit("gpt-5")).alias("model"))


@query("SELECT event_id, s.o AS origin, i AS session_id FROM (SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN {'o': CASE WHEN event_id % 2 = 0 THEN 'cli' END} END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN event_type = 'signup' THEN nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || event_id END, '') END IGNORE NULLS) OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))")
def carry_forward_session_meta(spark, sf_dir):
    """Session ids only non-blank ones overwrite; origins every header overwrites, unknown too."""
    head = F.col("event_type") == "signup"
    origin = F.when(head, F.struct(F.when(F.col("event_id") % 2 == 0, "cli").alias("o")))
    ident = F.when(head, S.blank_to_null(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), "event_id"))))
    keys = (["user_id"], ["event_id"])
    return table(spark, sf_dir, "events").select("event_id", ordered.carried(origin, *keys)["o"].alias("origin"), ordered.carried(ident, *keys).alias("session_id"))


@query("SELECT origin, count(*) AS n FROM (SELECT last_value(CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'interactive' WHEN 1 THEN 'exec' ELSE 'subagent' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS origin FROM events) WHERE origin IN ('interactive', 'exec') GROUP BY origin")
def scope_filter(spark, sf_dir):
    """Rows of sessions with wanted origins."""
    kind = F.col("event_id") % 3
    origin = F.when(F.col("event_type") == "signup", F.when(kind == 0, "interactive").when(kind == 1, "exec").otherwise("subagent"))
    rows = table(spark, sf_dir, "events").select(ordered.carried(origin, ["user_id"], ["event_id"]).alias("origin"))
    return rows.where(F.col("origin").isin("interactive", "exec")).groupBy("origin").agg(F.count("*").alias("n"))


@query("WITH " + LEDGER_SQL + "," + _RESOLVE + f" SELECT model, coalesce(stage, 0) AS stage, matched, {', '.join(f'r_{r} AS {r}' for r in RATES)} FROM resolved")
def price_resolution(spark, sf_dir):
    """Rates of each model, by the first stage with a hit, null where ambiguous."""
    found = pricing.resolve(events_ledger(spark, sf_dir), price_table(spark))
    return found.select("model", F.coalesce("stage", F.lit(0)).alias("stage"), "matched", *[F.col(f"rates.{r}").alias(r) for r in RATES])


@query("WITH " + LEDGER_SQL + "," + _RESOLVE + " SELECT model, count(*) AS entries FROM ledger JOIN resolved USING (model) WHERE matched IS NULL AND stage IS NOT NULL GROUP BY model")
def price_ambiguity(spark, sf_dir):
    """Models that more than one catalogue entry claims."""
    ledger = events_ledger(spark, sf_dir)
    vetoed = pricing.resolve(ledger, price_table(spark)).where("matched IS NULL AND stage IS NOT NULL").select("model")
    return ledger.join(vetoed, "model").groupBy("model").agg(F.count("*").alias("entries"))


_FALLBACK = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(p_name), '{x}')" for x in parts) + f" THEN {i / 1e6!r}::DOUBLE" for parts, i, *_ in pricing.FALLBACK
)


@query(f"SELECT p_partkey, CASE {_FALLBACK} END AS input FROM (SELECT p_partkey, ['opus-4.5', 'Claude-Opus-3', 'sonnet', 'haiku', 'grok-build-1', 'grok-4', 'kimi-k2', 'gpt-5.4-mini', 'gpt-5.4', 'gpt-5.1-codex-mini', 'gpt-5.3-codex', 'gpt-5-codex', 'codex-mini', 'gpt-5', 'gpt-4o', 'other'][p_partkey % 16 + 1] || '-' || p_size AS p_name FROM part)")
def fallback_pricing(spark, sf_dir):
    """Rates by parts of names, first fit."""
    names = "array('opus-4.5', 'Claude-Opus-3', 'sonnet', 'haiku', 'grok-build-1', 'grok-4', 'kimi-k2', 'gpt-5.4-mini', 'gpt-5.4', 'gpt-5.1-codex-mini', 'gpt-5.3-codex', 'gpt-5-codex', 'codex-mini', 'gpt-5', 'gpt-4o', 'other')"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"concat(element_at({names}, cast(p_partkey % 16 + 1 AS int)), '-', p_size)").alias("m"))
    return rows.select("p_partkey", pricing.fallback_rates(F.col("m"))["input"].alias("input"))


@query(_with(_DAILY, _RESOLVE, _COSTED) + " SELECT CAST(date AS VARCHAR) AS date, model, round(cost, 6) AS cost FROM costed")
def token_cost(spark, sf_dir):
    """Cost by day and model."""
    return costed_days(spark, sf_dir).select(day(), "model", F.round("cost", 6).alias("cost"))


@query(_with(_DAILY, _RESOLVE, _COSTED) + " SELECT model, CAST(sum(recorded_entries) AS BIGINT) AS recorded_entries, round(sum(recorded_usd), 6) AS recorded_usd, round(sum(p), 6) AS priced_usd FROM costed GROUP BY model")
def recorded_vs_priced(spark, sf_dir):
    """Recorded cost beside the cost of what was priced locally."""
    rows = costed_days(spark, sf_dir)
    return rows.groupBy("model").agg(F.sum("recorded_entries").alias("recorded_entries"), F.round(F.sum("recorded_usd"), 6).alias("recorded_usd"), F.round(F.sum(pricing.token_cost("priced_")), 6).alias("priced_usd"))


_ACTUAL = ", ".join(f"greatest(priced_{t} - est_{t}, 0) AS actual_{t}" for t in TOKENS)


@query(
    _with(_DAILY, _RESOLVE)
    + f", a AS (SELECT *, {_ACTUAL} FROM daily LEFT JOIN resolved USING (model)), b AS (SELECT *, {_cost('actual_')} AS p, {_cost('est_')} AS e FROM a) "
    + f"SELECT CAST(date AS VARCHAR) AS date, model, round(CASE WHEN p IS NOT NULL THEN recorded_usd + p WHEN {_PTOTAL.replace('priced_', 'actual_')} > 0 AND recorded_usd = 0 THEN NULL ELSE recorded_usd END, 6) AS real_cost, round(e, 6) AS estimated_cost FROM b"
)
def real_only_cost(spark, sf_dir):
    """Cost without estimates, and of the estimates alone."""
    return costed_days(spark, sf_dir).select(day(), "model", F.round("real_cost", 6).alias("real_cost"), F.round("estimated_cost", 6).alias("estimated_cost"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN p >= 200000 THEN ((p - c) * 4 + c * CASE WHEN l_suppkey % 2 = 0 THEN 0.6 ELSE 1 END + o * 12) / 1e6::DOUBLE ELSE ((p - c) * 2 + c * CASE WHEN l_suppkey % 2 = 0 THEN 0.3 ELSE 0.5 END + o * 6) / 1e6::DOUBLE END, 8) AS cost FROM (SELECT *, CAST(floor(l_extendedprice * 5) AS BIGINT) AS p, CAST(floor(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_quantity) AS BIGINT) AS o FROM lineitem)")
def tiered_cost(spark, sf_dir):
    """Requests priced by the length of their prompts."""
    p, c, o = F.floor(F.col("l_extendedprice") * 5).cast("long"), F.floor("l_extendedprice").cast("long"), F.floor("l_quantity").cast("long")
    version = F.when(F.col("l_suppkey") % 2 == 0, "4.5").otherwise("4.6")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(pricing.tiered_cost(version, p, c, o), 8).alias("cost"))


@query(_with(_DAILY, _RESOLVE, _COSTED) + f" SELECT CAST(date AS VARCHAR) AS date, round({_KNOWN}, 6) AS cost FROM costed GROUP BY date")
def unknown_cost_null_skip(spark, sf_dir):
    """Daily cost; unknown models are left out."""
    return costed_days(spark, sf_dir).groupBy(day()).agg(F.round(pricing.known_sum(), 6).alias("cost"))


@query(_with(_DAILY, _RESOLVE, _COSTED) + " SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN count(*) = count(cost) THEN sum(cost) END, 6) AS cost FROM costed GROUP BY date")
def unknown_cost_contaminate(spark, sf_dir):
    """Daily cost; one unknown model makes it unknown."""
    return costed_days(spark, sf_dir).groupBy(day()).agg(F.round(pricing.strict_sum(), 6).alias("cost"))


@query(
    _with(_DAILY, _RESOLVE)
    + f", s AS (SELECT date, model, 'recorded' AS src FROM daily WHERE recorded_entries > 0 UNION SELECT date, daily.model, CASE WHEN matched IS NOT NULL THEN 'catalogue' ELSE 'unknown' END FROM daily LEFT JOIN resolved USING (model) WHERE {_PTOTAL} > 0) "
    "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(DISTINCT src) = 1 THEN min(src) ELSE 'mixed' END AS pricing_source FROM s GROUP BY date"
)
def pricing_provenance(spark, sf_dir):
    """Where the prices of a day come from."""
    return costed_days(spark, sf_dir).groupBy(day()).agg(pricing.provenance().alias("pricing_source"))


@query(_with(f"r AS (SELECT session_key, {_SUMS} FROM stats GROUP BY session_key)") + f" SELECT {_KIND} AS cost_kind, count(*) AS sessions FROM r GROUP BY 1")
def cost_kind(spark, sf_dir):
    """Sessions by kind of cost."""
    return reports.by(facts(spark, sf_dir, *MEASURED), "session_key").groupBy(M.cost_kind().alias("cost_kind")).agg(F.count("*").alias("sessions"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice * 0.92::DOUBLE, 4) AS eur FROM orders")
def currency_convert(spark, sf_dir):
    """Costs in another currency."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(pricing.converted(F.col("o_totalprice"), {"EUR": 0.92}, "eur"), 4).alias("eur"))


@query(
    "WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 AS cost FROM lineitem GROUP BY 1), "
    "d AS (SELECT *, day(last_day(CAST(month || '-01' AS DATE))) AS dim, CASE WHEN month = '1998-06' THEN 15 ELSE day(last_day(CAST(month || '-01' AS DATE))) END AS el FROM m), "
    "p AS (SELECT *, cost * dim / el AS projected FROM d) "
    "SELECT month, round(cost, 2) AS cost, round(projected, 2) AS projected, round(1000000::DOUBLE - cost, 2) AS remaining, round(cost * 100 / 1000000::DOUBLE, 4) AS used_pct, CASE WHEN cost > 1000000 THEN 'over_budget' WHEN projected * 100 / 1000000::DOUBLE >= 90 THEN 'watch' ELSE 'on_track' END AS status FROM p"
)
def monthly_budget(spark, sf_dir):
    """Months against a budget, the current month projected."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100).alias("cost"))
    rows = forecast.monthly_budget(months, 1_000_000.0, "1998-06-15")
    return rows.select("month", *[F.round(c, 2).alias(c) for c in ("cost", "projected", "remaining")], F.round("used_pct", 4).alias("used_pct"), "status")


@query(
    "WITH q AS (SELECT user_id, max_by(CAST(floor(value) AS BIGINT) % 110, event_id) AS used, max_by(event_id, event_id) AS seen FROM events GROUP BY user_id), "
    "s AS (SELECT user_id, used, 1000000 + seen % 500000 AS observed, 1000000 + 604800 - seen % 300000 AS resets FROM q), "
    "e AS (SELECT *, resets - 604800 AS start, observed - (resets - 604800) AS elapsed FROM s), "
    "p AS (SELECT *, CASE WHEN observed > 1200000 + 300 THEN 'future' WHEN resets <= 1200000 THEN 'expired' WHEN elapsed <= 0 OR observed > resets THEN 'bad_timing' END AS error FROM e), "
    "r AS (SELECT *, CASE WHEN error IS NULL THEN used * 604800::DOUBLE / elapsed END AS projected FROM p) "
    "SELECT user_id, used AS used_percent, error, round(projected, 4) AS projected_percent, CASE WHEN projected > 100 THEN start + CAST(round(elapsed * 100 / used::DOUBLE) AS BIGINT) ELSE 0 END AS depletes_at, "
    "CASE WHEN error IS NOT NULL THEN NULL WHEN used >= 100 THEN 'exhausted' WHEN projected > 100 THEN 'likely_exhausted' WHEN projected >= 90 THEN 'watch' ELSE 'on_track' END AS status FROM r"
)
def quota_pace(spark, sf_dir):
    """The newest quota snapshot of each user, projected to the end of its window."""
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.floor("value").cast("long") % 110, "event_id").alias("used_percent"), F.max("event_id").alias("at"))
    snapshots = newest.select("user_id", "used_percent", F.lit(10080).cast("long").alias("window_minutes"), (1000000 + F.col("at") % 500000).alias("observed_at"), (1000000 + 604800 - F.col("at") % 300000).alias("resets_at"))
    rows = forecast.quota_pace(snapshots, F.lit(1200000).cast("long"))
    return rows.select("user_id", "used_percent", "error", F.round("projected_percent", 4).alias("projected_percent"), F.coalesce("depletes_at", F.lit(0)).alias("depletes_at"), "status")


@query(
    _with(f"w AS (SELECT model, {_SUMS} FROM stats WHERE timestamp_ms BETWEEN 1704153600000 AND 1704758400000 GROUP BY model)", _RESOLVE)
    + f", c AS (SELECT model, {_TOTAL} AS tokens, {_cost('priced_')} AS cost, matched FROM w LEFT JOIN resolved USING (model)), t AS (SELECT CAST(sum(tokens) AS BIGINT) AS tokens, list(model ORDER BY model) FILTER (matched IS NULL) AS u FROM c) "
    "SELECT tokens, 'unpriced: ' || array_to_string(u, ', ') AS error, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS window_tokens FROM t"
)
def weekly_value(spark, sf_dir):
    """The value of a quota window; models without a price make it unknown."""
    inside = facts(spark, sf_dir, *MEASURED).where(F.col("timestamp_ms").between(1704153600000, 1704758400000))
    rows = reports.by(inside, "model")
    rows = pricing.costed(rows, price_table(spark))
    usage = rows.agg(F.sum(M.total_tokens()).alias("tokens"), pricing.known_sum().alias("cost"), F.collect_set(F.when(F.col("pricing_source") == "unknown", F.col("model"))).alias("unpriced"))
    return forecast.window_value(usage, F.lit(25.0)).select("tokens", "error", "value", "window_tokens")


def _top(dim: str, source: str) -> str:
    return (
        f", t AS (SELECT {dim}, {_KNOWN} AS cost, CAST(sum({_TOTAL}) AS BIGINT) AS tokens FROM {source} GROUP BY {dim}), s AS (SELECT * FROM t ORDER BY cost DESC NULLS LAST, tokens DESC, {dim} LIMIT 10), "
        f"b AS (SELECT *, CASE WHEN bool_and(coalesce(cost > 0, false)) OVER () THEN cost ELSE tokens::DOUBLE END AS basis FROM s) "
        f"SELECT row_number() OVER (ORDER BY cost DESC NULLS LAST, tokens DESC, {dim}) AS rank, {dim}, round(cost, 5) AS cost, tokens, round(basis * 100 / sum(basis) OVER (), 2) AS share FROM b"
    )


@query(_with(_DAILY, _RESOLVE, _COSTED) + _top("model", "costed"))
def top_models(spark, sf_dir):
    """Models by cost with their shares."""
    rows = costed_days(spark, sf_dir).groupBy("model").agg(pricing.known_sum().alias("cost"), F.sum(M.total_tokens()).alias("tokens"))
    return reports.top(rows, "model").select("rank", "model", F.round("cost", 5).alias("cost"), "tokens", "share")


@query(
    _with(
        "began AS (SELECT session_key, arg_min(project_path, (file_path, line_ord)) AS began FROM deduped GROUP BY session_key)",
        f"daily AS (SELECT began AS project_path, model, {_SUMS} FROM stats JOIN began USING (session_key) GROUP BY ALL)", _RESOLVE, _COSTED,
    ) + _top("project_path", "costed")
)
def top_projects(spark, sf_dir):
    """Projects by cost with their shares; a session belongs to the project it began in."""
    rows = reports.project_models(reports.session_models(facts(spark, sf_dir, *MEASURED, "session_id", "project_path", "timestamp")))
    rows = pricing.costed(rows, price_table(spark))
    rows = rows.groupBy("project_path").agg(pricing.known_sum().alias("cost"), F.sum(M.total_tokens()).alias("tokens"))
    return reports.top(rows, "project_path").select("rank", "project_path", F.round("cost", 5).alias("cost"), "tokens", "share")


@query("WITH t AS (SELECT 'part-' || l_partkey AS part, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1), s AS (SELECT * FROM t ORDER BY tokens DESC, part LIMIT 25) SELECT row_number() OVER (ORDER BY tokens DESC, part) AS rank, part, tokens, round(tokens::DOUBLE * 100 / sum(tokens) OVER (), 2) AS share FROM s")
def share_of_total(spark, sf_dir):
    """A ranking without known cost shows shares of tokens."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part-"), F.col("l_partkey")).alias("part")).agg(F.sum(F.floor("l_quantity").cast("long")).alias("tokens"))
    return reports.top(rows.withColumn("cost", F.lit(None).cast("double")), "part", 25).select("rank", "part", "tokens", "share")


@query(_with(_SESSIONS) + " SELECT session_key, row_number() OVER (ORDER BY last_ms NULLS FIRST, last_timestamp, session_key) AS place FROM sessions")
def session_sort(spark, sf_dir):
    """Sessions in order of their last activity."""
    rows = reports.sessions(facts(spark, sf_dir, *MEASURED, "session_id", "project_path", "timestamp")).select("session_key", "last_ms", "last_timestamp")
    return ordered.placed(rows, [F.col("last_ms").asc_nulls_first(), F.col("last_timestamp"), F.col("session_key")]).select("session_key", "place")


@query(
    _with(f"daily AS (SELECT project_path, model, {_SUMS} FROM stats GROUP BY ALL)", _RESOLVE, _COSTED)
    + ", t AS (SELECT project_path, CASE WHEN count(*) = count(cost) THEN sum(cost) END AS cost FROM costed GROUP BY project_path) SELECT project_path, row_number() OVER (ORDER BY round(cost, 6) DESC NULLS FIRST, project_path) AS place FROM t"
)
def project_sort_nulls(spark, sf_dir):
    """Projects by falling cost, unknown cost first."""
    rows = reports.by(facts(spark, sf_dir, *MEASURED, "project_path"), "project_path", "model")
    rows = pricing.costed(rows, price_table(spark)).groupBy("project_path").agg(pricing.strict_sum().alias("cost"))
    return ordered.placed(rows, [F.round("cost", 6).desc_nulls_first(), F.col("project_path")]).select("project_path", "place")


@query(
    "WITH " + LEDGER_SQL.replace("FROM ledger", "FROM ledger WHERE date = DATE '2024-01-15'") + f", stats AS (SELECT *, {_STATS} FROM deduped) SELECT {_TOTAL} AS total_tokens, call_count, {_HIT} AS hit_rate, '15 Jan: ' || call_count || ' calls' AS line FROM (SELECT {_SUMS} FROM stats)"
)
def statusline(spark, sf_dir):
    """One day in one line."""
    rows = reports.statusline(dedup.best_candidate(reports.in_range(events_ledger(spark, sf_dir), "2024-01-15", "2024-01-15")))
    return rows.select("total_tokens", "call_count", F.round(M.hit_rate(), 6).alias("hit_rate"), F.format_string("15 Jan: %d calls", "call_count").alias("line"))


@query(
    "WITH p AS (SELECT o_custkey, 'supp-' || l_suppkey % 3 AS model, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "parts AS (SELECT o_custkey, model, sum(q) AS q FROM p GROUP BY ALL), whole AS (SELECT o_custkey, sum(q) - o_custkey % 50 + 20 AS q, sum(q) AS s FROM p GROUP BY o_custkey), "
    "u AS (SELECT * FROM parts UNION ALL SELECT o_custkey, 'supp-0', greatest(q - s, 0) FROM whole) SELECT o_custkey, model, CAST(sum(q) AS BIGINT) AS q FROM u GROUP BY ALL HAVING sum(q) > 0"
)
def residual_attribution(spark, sf_dir):
    """Totals whose parts do not add up: the rest goes to the fallback model."""
    from .plans.ledger import order_lines

    lines = order_lines(spark, sf_dir).select("o_custkey", F.concat(F.lit("supp-"), F.col("l_suppkey") % 3).alias("m"), F.floor("l_quantity").cast("long").alias("q"))
    parts = lines.groupBy("o_custkey", "m").agg(F.sum("q").alias("q"))  # at most three models for each customer
    rows = parts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("q")))).alias("parts"), F.sum("q").alias("s"))
    rows = rows.select("o_custkey", "parts", F.lit("supp-0").alias("model"), (F.col("s") - F.col("o_custkey") % 50 + 20).alias("q"))
    return ordered.residual(rows, ["o_custkey"], "parts", ["q"])


@query(
    "WITH g AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN l_suppkey % 5 END AS grp, CAST(floor(l_extendedprice) AS BIGINT) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "a AS (SELECT o_custkey, max(t) AS t FROM g GROUP BY 1), b AS (SELECT o_custkey, CAST(sum(t) AS BIGINT) AS t FROM (SELECT o_custkey, grp, max(t) AS t FROM g WHERE grp IS NOT NULL GROUP BY ALL) GROUP BY 1) "
    "SELECT o_custkey, coalesce(b.t, a.t) AS t FROM a LEFT JOIN b USING (o_custkey)"
)
def context_snapshot_fallback(spark, sf_dir):
    """Usage known by growing snapshots only."""
    from .plans.ledger import order_lines

    rows = order_lines(spark, sf_dir).select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.col("l_suppkey") % 5).alias("grp"), F.floor("l_extendedprice").cast("long").alias("t"))
    return ordered.snapshot_tokens(rows, "o_custkey", "grp", "t")


@query(
    "WITH o AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS key, event_id AS ord, value FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS key, event_id AS ord, value FROM events WHERE event_id % 2 = 1), "
    "ol AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1), nl AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1) "
    "SELECT * FROM ol WHERE key NOT IN (SELECT key FROM nl) UNION ALL SELECT * FROM nl"
)
def ledger_upsert(spark, sf_dir):
    """A ledger with new records; the last one of a key wins."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("key"), F.col("event_id").alias("ord"), "value")
    old = dedup.last_by(rows.where(F.col("ord") % 2 == 0), ["key"], "ord")
    return dedup.upsert(old, rows.where(F.col("ord") % 2 == 1), "key", "ord")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_snapshot(spark, sf_dir):
    """The newest record of each user."""
    newest = F.max_by(F.struct("event_type", "value"), "event_id").alias("s")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "s.event_type", "s.value")


@query("SELECT event_id, i AS place, json_extract_string(props, '$.k')::BIGINT + i AS k FROM events, unnest(range(event_id % 3)) t(i)")
def json_events_explode(spark, sf_dir):
    """Elements of arrays in JSON payloads, with their places."""
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.concat(F.lit('{"events":['), F.array_join(F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.col("event_id") % 3), lambda i: F.concat(F.lit('{"k":'), (k + i).cast("string"), F.lit("}"))), ","), F.lit("]}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(payload, "events array<struct<k:bigint>>").alias("p"))
    return rows.select("event_id", F.posexplode("p.events").alias("place", "e")).select("event_id", F.col("place").cast("long").alias("place"), "e.k")


@query("SELECT s_suppkey, coalesce(n_name, '') AS project, coalesce(r_name, 'grok') AS model FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def metadata_left_join(spark, sf_dir):
    """Facts with optional metadata and defaults."""
    meta = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = table(spark, sf_dir, "supplier").join(meta, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("project"), F.coalesce("r_name", F.lit("grok")).alias("model"))


@query(_with(_DAILY) + " SELECT CAST(date AS VARCHAR) AS period, '[' || string_agg('{\"model\":\"' || model || '\",\"input_tokens\":' || input_tokens || '}', ',' ORDER BY model) || ']' AS models FROM daily GROUP BY date")
def period_json(spark, sf_dir):
    """A period's models as one JSON array."""
    each = F.sort_array(F.collect_list(F.struct("model", "input_tokens")))
    return reports.daily(facts(spark, sf_dir, *MEASURED, "date")).groupBy(F.col("date").cast("string").alias("period")).agg(F.to_json(each).alias("models"))


@query(_with(_DAILY) + ", r AS (SELECT date, list(DISTINCT model ORDER BY model) AS m, CAST(sum(" + _TOTAL + ") AS BIGINT) AS t FROM daily GROUP BY date) SELECT strftime(date, '%Y-%m-%d') || ',' || CASE WHEN len(m) > 1 THEN '\"' || array_to_string(m, ', ') || '\"' ELSE m[1] END || ',' || t AS line FROM r")
def period_csv(spark, sf_dir):
    """Periods as CSV lines; fields with commas are quoted."""
    rows = reports.daily(facts(spark, sf_dir, *MEASURED, "date")).groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("m"), F.sum(M.total_tokens()).alias("t"))
    return rows.select(F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), S.csv_field(F.col("m")), S.csv_field(F.col("t"))).alias("line"))


@query(
    "SELECT l_suppkey % 10 AS model, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS calls, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'N', l_shipdate DESC, l_partkey, l_suppkey, l_quantity) = 1) GROUP BY ALL"
)
def order_line_dedup(spark, sf_dir):
    """The large ledger: best candidates of (order, line), then months and models."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    best = dedup.first_by(lines, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "N", F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity")
    return best.groupBy((F.col("l_suppkey") % 10).alias("model"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.sum(F.floor("l_quantity").cast("long")).alias("tokens"))
