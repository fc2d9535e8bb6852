"""The additive measures of usage and what derives from their sums.

Every report is one partial and final hash aggregation of the same expressions. Unknown cost is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISJOINT, TOKENS

MOST = 2**63 - 1


def with_cost_parts(df: DataFrame) -> DataFrame:
    """Adds which tokens a catalogue prices (priced_*), which of them are estimates (est_*), and the recorded cost.

    Estimates are priced; else a recorded cost stands for the tokens; else the tokens are priced.
    """
    proxy = F.col("cost_kind") == "estimated_proxy"
    recorded = ~proxy & F.col("recorded_cost_usd").isNotNull()
    priced = [F.when(recorded, 0).otherwise(F.col(t)).alias(f"priced_{t}") for t in TOKENS]
    estimated = [F.when(proxy, F.col(t)).otherwise(0).alias(f"est_{t}") for t in TOKENS]
    return df.select(
        "*", *priced, *estimated,
        F.when(recorded, F.greatest("recorded_cost_usd", F.lit(0.0))).otherwise(0.0).alias("recorded_usd"),
        recorded.cast("long").alias("recorded_entries"), proxy.cast("long").alias("proxy_entries"), (~proxy).cast("long").alias("real_entries"),
    )


def saturated(c: Column) -> Column:
    """A sum of numbers that are not negative (null is 0), which stops at the largest long instead of failing; null without rows."""
    return F.when(F.count("*") > 0, F.coalesce(F.try_sum(F.coalesce(c, F.lit(0))), F.lit(MOST)))


def sums() -> list[Column]:
    """Aggregate expressions over the columns of with_cost_parts; counts saturate."""
    names = [*TOKENS, "call_count", *(f"priced_{t}" for t in TOKENS), *(f"est_{t}" for t in TOKENS), "recorded_entries", "proxy_entries", "real_entries"]
    return [*(saturated(F.col(n)).alias(n) for n in names), F.sum("recorded_usd").alias("recorded_usd"), F.count("*").alias("entries")]


def resums() -> list[Column]:
    """The same over rows that are sums already."""
    return [*(x for x in sums()[:-1]), F.sum("entries").alias("entries")]


def total_tokens(prefix: str = "") -> Column:
    """All tokens once, at most the largest long; null if any is."""
    total, known = F.col(prefix + DISJOINT[0]), F.col(prefix + DISJOINT[0]).isNotNull()
    for t in DISJOINT[1:]:
        total, known = F.try_add(total, F.col(prefix + t)), known & F.col(prefix + t).isNotNull()
    return F.coalesce(total, F.when(known, F.lit(MOST)))


def hit_rate(supported: bool = True) -> Column:
    """Percent of prompt tokens read from cache; null if unsupported or without prompt tokens."""
    at_least_0 = lambda n: F.greatest(F.col(n), F.lit(0))
    read, prompt = at_least_0("cache_read"), at_least_0("input_tokens") + at_least_0("cache_creation") + at_least_0("cache_read")
    return F.when(F.lit(supported) & (prompt > 0), read * 100.0 / prompt)


def cost_kind() -> Column:
    """real, estimated_proxy or mixed from summed counts."""
    proxy, real = F.col("proxy_entries") > 0, F.col("real_entries") > 0
    return F.when(proxy & real, "mixed").when(proxy, "estimated_proxy").otherwise("real")
