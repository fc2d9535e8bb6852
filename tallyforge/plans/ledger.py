"""Usage ledgers over the driver's tables, so every operator runs on data that other engines can read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, RATES

#: price_key and USD for a token, in the order of RATES.
PRICES = (
    ("claude-sonnet-4-20250514", 3e-6, 15e-6, 15e-6, 3.75e-6, 6e-6, 0.3e-6),
    ("claude-opus-4-20250514", 15e-6, 75e-6, 75e-6, 18.75e-6, 30e-6, 1.5e-6),
    ("claude-opus-4-20250805", 14e-6, 70e-6, 70e-6, 17.5e-6, 28e-6, 1.4e-6),
    ("openai/gpt-5", 1.25e-6, 10e-6, 10e-6, 0.0, 0.0, 0.125e-6),
    ("xai/grok-4", 3e-6, 15e-6, 15e-6, 0.0, 0.0, 0.75e-6),
    ("haiku-4.5", 1e-6, 5e-6, 5e-6, 1.25e-6, 2e-6, 0.1e-6),
)

_COMMON = """
    CAST('s' || user_id AS {text}) AS session_key, CAST('u' || user_id AS {text}) AS session_id,
    CASE WHEN user_id % 11 = 0 THEN '-home-work' ELSE '/home/p/' || (user_id % 8) END AS project_path,
    CASE event_type WHEN 'click' THEN 'claude-sonnet-4-20250514' WHEN 'view' THEN 'gpt-5' WHEN 'purchase' THEN 'anthropic.claude-opus-4'
                    WHEN 'signup' THEN 'xai/grok-4' ELSE CASE WHEN event_id % 2 = 0 THEN 'claude-haiku-4p5' ELSE 'mystery-model' END END AS model,
    CAST(floor(value) AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) % 97 AS output_tokens,
    (event_id % 11) * 3 AS cache_creation, least(event_id % 7, (event_id % 11) * 3) AS cache_creation_1h,
    event_id % 23 AS cache_read, event_id % 4 AS reasoning_tokens,
    CASE WHEN event_id % 3 = 0 THEN 'end_turn' END AS stop_reason,
    CASE WHEN event_id % 13 = 0 THEN 'estimated_proxy' ELSE 'real' END AS cost_kind,
    CASE event_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'proxy' ELSE 'unknown' END AS endpoint,
    CAST(1 AS BIGINT) AS call_count, CASE WHEN event_id % 19 = 0 THEN value / 1000 END AS recorded_cost_usd,
    CAST('f' || (user_id % 4) AS {text}) AS file_path, event_id AS line_ord
"""
_IDS = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'source-wide:m' || (user_id % 20) || ':' || k ELSE 'm' || user_id || ':' || k END AS message_id"


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as usage facts; natural duplicates by (user, k)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS timestamp"
    rows = events.selectExpr("'events' AS source", stamp, "unix_millis(cast(ts AS timestamp)) AS timestamp_ms", "cast(ts AS date) AS date", _IDS, *_split(_COMMON.format(text="string")))
    return rows.withColumn("dedup_scope", F.when(F.col("message_id").startswith("source-wide:"), "").otherwise(F.col("session_key"))).select(*COLUMNS)


def _split(select: str) -> list[str]:
    """Top-level parts of a select list."""
    parts, depth, now = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


LEDGER_SQL = f"""
ledger AS (
  SELECT 'events' AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, epoch_us(ts) // 1000 AS timestamp_ms, CAST(ts AS DATE) AS date, {_IDS}, {_COMMON.format(text="VARCHAR")}
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
), keyed AS (
  SELECT *, CASE WHEN message_id LIKE 'source-wide:%' THEN '' ELSE session_key END AS scope FROM ledger
), deduped AS (
  SELECT * FROM keyed WHERE message_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scope, message_id ORDER BY stop_reason IS NULL, timestamp_ms DESC, file_path, line_ord) = 1
  UNION ALL SELECT * FROM keyed WHERE message_id IS NULL AND stop_reason IS NOT NULL
)"""


def price_table(spark: SparkSession) -> DataFrame:
    """PRICES as a table."""
    rows = ", ".join(f"({', '.join(repr(x) if isinstance(x, str) else f'{x!r}D' for x in p)})" for p in PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(price_key, {', '.join(RATES)})")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a large ledger: supplier is the model, customer the session."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
