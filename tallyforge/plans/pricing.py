"""Model prices: catalogue, conservative name resolution, fallback rates, cost and its roll-ups.

Names are resolved on the distinct models of a report, a small table, and joined to its rows. Unknown cost is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import total_tokens
from ..functions.scalars import dotted_version
from ..schema import RATES
from ..staging import staged

# Fixed values: (name parts, input, output, cache read, cache write, cache write for an hour), USD for a million tokens;
# the first row of which a part occurs in the model's name counts.
FALLBACK = (
    (("opus-4-5", "opus-4.5"), 5, 25, 0.5, 6.25, 10),
    (("opus",), 15, 75, 1.5, 18.75, 30),
    (("sonnet",), 3, 15, 0.3, 3.75, 6),
    (("haiku",), 0.8, 4, 0.08, 1, 1.6),
    (("grok-build",), 1, 2, 0.2, 0, 0),
    (("grok",), 1.25, 2.5, 0.2, 0, 0),
    (("kimi",), 0.95, 4, 0.16, 0, 0),
    (("gpt-5.4-mini",), 0.75, 4.5, 0.075, 0, 0),
    (("gpt-5.4-nano",), 0.2, 1.25, 0.02, 0, 0),
    (("gpt-5.4",), 2.5, 15, 0.25, 0, 0),
    (("gpt-5.1-codex-mini",), 0.25, 2, 0.025, 0, 0),
    (("gpt-5.2-codex", "gpt-5.3-codex"), 1.75, 14, 0.175, 0, 0),
    (("gpt-5-codex", "gpt-5.1-codex"), 1.25, 10, 0.125, 0, 0),
    (("codex-mini",), 1.5, 6, 0.375, 0, 0),
    (("codex", "gpt-5"), 1.25, 10, 0.125, 0, 0),
    (("gpt-4",), 2.5, 10, 0, 0, 0),
)
# USD for a million tokens (prompt, cached prompt, completion) below and from LONG_PROMPT prompt tokens.
LONG_PROMPT = 200_000
TIERS = {"4.5": ((2, 0.3, 6), (4, 0.6, 12)), "4.6": ((2, 0.5, 6), (4, 1, 12))}
# Vendors whose names win over those that host the same model.
OFFICIAL = ("zai/", "deepseek/", "dashscope/", "moonshot/")
VENDORS = (r"^anthropic\.", "^anthropic/", "^openai/", "^xai/")

RATES_TYPE = "struct<" + ",".join(f"{r}:double" for r in RATES) + ">"


@dataclass(frozen=True)
class Prices:
    """A price table (price_key and RATES) and where it is from: catalogue, live, cache, cache_stale or fallback; of a cache also its age and time."""

    table: DataFrame
    source: str = "catalogue"
    age_s: int | None = None
    mtime_s: int | None = None

    @classmethod
    def of(cls, prices: Prices | DataFrame) -> Prices:
        return prices if isinstance(prices, Prices) else cls(prices)


@dataclass(frozen=True)
class Currency:
    """What costs are shown in: units of code for a dollar."""

    code: str = "USD"
    rate: float = 1.0

    @classmethod
    def of(cls, code: str, rates: dict[str, float]) -> Currency:
        code = code.strip().upper()
        if code != "USD" and code not in rates:
            raise ValueError(f"no exchange rate for {code}")
        rate = 1.0 if code == "USD" else float(rates[code])
        if not 0 < rate < float("inf"):
            raise ValueError(f"the exchange rate for {code} is no positive number")
        return cls(code, rate)


def catalogue(raw: DataFrame) -> DataFrame:
    """Rates by lookup key from (name, costs struct) rows: known vendors only, aliases added, official vendors first."""
    n, c = F.col("name"), F.col("costs")
    claude, openai = n.contains("claude"), n.startswith("openai/") | n.startswith("gpt-") | n.startswith("codex")
    xai = n.startswith("xai/") | n.startswith("grok-")
    other = n.contains("deepseek") | n.contains("qwen") | n.contains("glm") | n.startswith("moonshot/") | n.contains("kimi")
    zero = F.lit(0.0)
    output, write = F.coalesce(c["output_cost_per_token"], zero), F.coalesce(c["cache_creation_input_token_cost"], zero)
    rates = F.struct(
        F.coalesce(c["input_cost_per_token"], zero).alias("input"), output.alias("output"),
        F.coalesce(c["reasoning_output_cost_per_token"], c["reasoning_cost_per_token"], output).alias("reasoning_output"),
        write.alias("cache_create"), F.coalesce(c["cache_creation_input_token_cost_above_1hr"], write).alias("cache_create_1h"),
        F.coalesce(c["cache_read_input_token_cost"], zero).alias("cache_read"),
    )
    bare = F.lower(F.element_at(F.split(n, "/"), -1))
    stripped = F.regexp_replace(n, "^(openai|xai)/", "")
    official = ~n.contains("/")
    for vendor in OFFICIAL:
        official = official | n.startswith(vendor)
    alias = (
        F.when(claude, F.array(F.replace(F.replace(n, F.lit("claude-"), F.lit("")), F.lit("anthropic."), F.lit(""))))
        .when(openai, F.array(stripped))
        .when(xai, F.when(n == "xai/grok-build-0.1", F.array(stripped, F.lit("grok-build"))).otherwise(F.array(stripped)))
        .otherwise(F.array(bare, dotted_version(bare)))
    )
    known = raw.where((claude | openai | xai | other) & (c["input_cost_per_token"].isNotNull() | c["output_cost_per_token"].isNotNull()))
    own = known.select(n.alias("price_key"), rates.alias("rates"), F.lit(0).alias("rank"), n.alias("__from"))
    more = known.select(F.explode(alias).alias("price_key"), rates.alias("rates"), F.when(official, 1).otherwise(2).alias("rank"), n.alias("__from"))
    every = own.unionByName(more.where("price_key != '' AND price_key != __from"))
    best = every.groupBy("price_key").agg(F.min_by("rates", F.struct("rank", "__from")).alias("rates"))
    return best.select("price_key", *[F.col(f"rates.{r}").alias(r) for r in RATES])


def _family(key: Column) -> Column:
    return F.arrays_overlap(F.split(key, "[-./_]"), F.array(*map(F.lit, ("sonnet", "opus", "haiku"))))


def _with_dotted(keys: Column) -> Column:
    return F.filter(F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array(k, dotted_version(k))))), lambda k: k != "")


def _without_vendor(keys: Column) -> Column:
    without = lambda v: lambda k: F.regexp_replace(k, v, "")  # noqa: E731  a second argument would be the index
    out = keys
    for v in VENDORS:
        out = F.concat(out, F.transform(keys, without(v)))
    return _with_dotted(out)


def exact_keys(model: Column) -> Column:
    """Spellings under which the catalogue may hold a model."""
    keys = _without_vendor(_with_dotted(F.array(model, F.lower(model))))
    keys = _with_dotted(F.concat(keys, F.transform(F.filter(keys, lambda k: k.startswith("claude-")), lambda k: F.regexp_replace(k, "^claude-", ""))))
    claude = F.filter(keys, lambda k: ~k.contains("/") & _family(k) & ~k.startswith("claude-"))
    gpt = F.filter(keys, lambda k: k.startswith("gpt-") | k.startswith("codex"))
    grok = F.filter(keys, lambda k: k.startswith("grok-"))
    prefixed = lambda p, some: F.transform(some, lambda k: F.concat(F.lit(p), k))
    return _with_dotted(F.concat(keys, prefixed("claude-", claude), prefixed("openai/", gpt), prefixed("xai/", grok)))


def canonical(key: Column) -> Column:
    """What spellings of one model have in common."""
    key = F.regexp_replace(F.lower(key), r"^(anthropic\.|anthropic/|openai/|xai/)", "")
    return F.regexp_replace(F.regexp_replace(key, r"^anthropic\.", ""), "^claude-", "")


DATED = "^(.+)-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"


def resolve(models: DataFrame, prices: Prices | DataFrame, strict: bool = True) -> DataFrame:
    """(model, stage, matched, rates, source) for distinct models; rates is null if nothing or more than one thing fits.

    Stages, the first with any hit decides: the name itself; its spellings; its spellings without a date; for Claude
    families, catalogue names that add a date. Within a stage, two canonical names or two rate vectors are ambiguous and
    end the search. Unless strict, models without rates get those of FALLBACK. models is read once, and one column of it; each
    distinct name meets the catalogue in one join.
    """
    given, m = Prices.of(prices), F.col("model")
    undated = F.filter(F.transform(_without_vendor(_with_dotted(F.array(m, F.lower(m)))), lambda k: F.regexp_extract(k, DATED, 1)), lambda k: k != "")
    plain = lambda k: F.regexp_replace(F.regexp_replace(k, r"^anthropic\.", ""), "^claude-", "")
    tries = lambda i, keys, kind, name: F.transform(keys, lambda k: F.struct(F.lit(i).alias("stage"), F.lit(kind).alias("kind"), k.alias("key"), name(k).alias("canonical")))
    bases = F.filter(F.array_distinct(F.transform(exact_keys(F.lower(m)), plain)), lambda k: _family(k) & ~k.rlike("-[0-9]{8}$"))
    tried = F.concat(
        tries(1, F.array_distinct(F.array(m, F.lower(m))), "name", F.lower), tries(2, exact_keys(m), "name", canonical),
        tries(3, _with_dotted(undated), "name", canonical), tries(4, bases, "base", lambda k: F.lit(None).cast("string")),
    )
    asked = models.select("model").where("model != ''").distinct().select("model", F.explode(tried).alias("t"))
    full = plain(F.lower("price_key"))
    entry = lambda kind, key, name: F.struct(F.lit(kind).alias("kind"), key.alias("key"), name.cast("string").alias("canonical"))
    entries = F.array(entry("name", F.col("price_key"), F.lit(None)), entry("base", F.regexp_extract(full, "^(.+)-[0-9]{8}$", 1), full))
    listed = given.table.select(F.explode(entries).alias("e"), "price_key", F.struct(*RATES).alias("rates")).where("e.key != ''")
    hit = F.struct(F.col("t.stage").alias("stage"), F.coalesce("t.canonical", "e.canonical").alias("name"), "rates", F.col("price_key").alias("key"))
    pairs = asked.join(listed, (F.col("t.kind") == F.col("e.kind")) & (F.col("t.key") == F.col("e.key")), "left")
    found = pairs.groupBy("model").agg(F.collect_set(F.when(F.col("price_key").isNotNull(), hit)).alias("hits"))  # the catalogue entries that spell this model
    stage = F.array_min(F.transform("hits", lambda h: h["stage"]))
    found = found.withColumn("stage", stage).withColumn("hits", F.filter("hits", lambda h: h["stage"] == F.col("stage")))
    distinct = lambda f: F.size(F.array_distinct(F.transform("hits", lambda h: h[f])))
    one = (distinct("name") == 1) & (distinct("rates") == 1)
    out = found.select("model", "stage", F.when(one, F.array_min(F.transform("hits", lambda h: h["key"]))).alias("matched"), F.when(one, F.col("hits")[0]["rates"]).alias("rates"))
    fallback = F.lit(None).cast(RATES_TYPE) if strict else fallback_rates(m)
    source = F.when(F.col("rates").isNotNull(), given.source).when(fallback.isNotNull(), "fallback").otherwise("unknown")
    return out.select("model", "stage", "matched", F.coalesce("rates", fallback).alias("rates"), source.alias("source"))


def costed(sums: DataFrame, prices: Prices | DataFrame, strict: bool = True) -> DataFrame:
    """Sums by model with their costs. The sums are staged, so what they were made from is read once and their few models are resolved."""
    sums = staged(sums, "sums")
    return with_costs(sums, resolve(sums, prices, strict))


def fallback_rates(model: Column) -> Column:
    """Struct of rates by the first fitting row of FALLBACK."""
    out, name = F.lit(None).cast(RATES_TYPE), F.lower(model)
    for parts, input_, output, read, write, hour in reversed(FALLBACK):
        fits = F.lit(False)
        for p in parts:
            fits = fits | name.contains(p)
        values = dict(input=input_, output=output, reasoning_output=output, cache_create=write, cache_create_1h=hour, cache_read=read)
        out = F.when(fits, F.struct(*[F.lit(values[r] / 1e6).alias(r) for r in RATES])).otherwise(out)
    return out


def token_cost(prefix: str = "", rates: str = "rates") -> Column:
    """Cost of the tokens in columns with a prefix; 0 without tokens, null without rates."""
    t = lambda name: F.col(prefix + name)
    hour = F.least(t("cache_creation_1h"), t("cache_creation"))
    r = lambda name: F.col(f"{rates}.{name}")
    cost = (
        t("input_tokens") * r("input") + t("output_tokens") * r("output") + t("reasoning_tokens") * r("reasoning_output")
        + (t("cache_creation") - hour) * r("cache_create") + hour * r("cache_create_1h") + t("cache_read") * r("cache_read")
    )
    return F.when(total_tokens(prefix) == 0, 0.0).otherwise(cost)


def cost(prefix: str = "priced_") -> Column:
    """Recorded cost and that of the priced tokens; null if neither is known."""
    priced, recorded = token_cost(prefix), F.col("recorded_usd")
    return F.when(priced.isNotNull(), recorded + priced).when((total_tokens(prefix) > 0) & (recorded == 0), F.lit(None)).otherwise(recorded)


def with_costs(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds cost, real_cost and estimated_cost to rows of sums by model."""
    rates = resolved.select("model", "rates", F.col("source").alias("pricing_source"))
    joined = rows.join(rates, "model", "left")
    real = [F.greatest(F.col(f"priced_{t}") - F.col(f"est_{t}"), F.lit(0)).alias(f"actual_{t}") for t in ("input_tokens", "output_tokens", "cache_creation", "cache_creation_1h", "cache_read", "reasoning_tokens")]
    joined = joined.select("*", *real)
    out = joined.select("*", cost("priced_").alias("cost"), cost("actual_").alias("real_cost"), token_cost("est_").alias("estimated_cost"))
    return out.drop(*[f"actual_{t}" for t in ("input_tokens", "output_tokens", "cache_creation", "cache_creation_1h", "cache_read", "reasoning_tokens")])


def has_cost_input() -> Column:
    """Whether a row has anything to price."""
    return (total_tokens("priced_") > 0) | (F.col("recorded_entries") > 0) | (F.col("recorded_usd") > 0)


def known_sum(value: str = "cost", has: Column | None = None) -> Column:
    """Aggregate: sum of known costs; 0 if nothing was to price, null if all that was is unknown."""
    has = has_cost_input() if has is None else has
    return F.when(F.count_if(has) == 0, 0.0).otherwise(F.sum(F.when(has, F.col(value))))


def strict_sum(value: str = "cost") -> Column:
    """Aggregate: null as soon as one cost is unknown."""
    return F.when(F.count("*") == F.count(value), F.coalesce(F.sum(value), F.lit(0.0)))


def provenance(source: str = "pricing_source", default: str = "catalogue") -> Column:
    """Aggregate: the one source of prices, or mixed; the default if nothing was priced."""
    local = (total_tokens("priced_") > 0)
    names = F.array_distinct(F.flatten(F.collect_set(F.concat(F.when(F.col("recorded_entries") > 0, F.array(F.lit("recorded"))).otherwise(F.array().cast("array<string>")), F.when(local, F.array(F.coalesce(source, F.lit("unknown")))).otherwise(F.array().cast("array<string>"))))))
    return F.when(F.size(names) == 0, default).when(F.size(names) == 1, names[0]).otherwise("mixed")


def tiered_cost(version: Column, prompt: Column, cached: Column, completion: Column) -> Column:
    """Cost of one request whose rates depend on the length of its prompt; cached is part of prompt."""
    out = F.lit(None).cast("double")
    for name, tiers in TIERS.items():
        below, above = (((prompt - cached) * p + cached * c + completion * o) / 1e6 for p, c, o in tiers)
        out = F.when(version == name, F.when(prompt >= LONG_PROMPT, above).otherwise(below)).otherwise(out)
    return out


SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "KRW": "₩", "INR": "₹"}


def converted(usd: Column, rates: dict[str, float], code: str) -> Column:
    """A cost in another currency; unknown stays unknown."""
    return usd * F.lit(Currency.of(code, rates).rate)


def diagnostics(resolved: DataFrame) -> DataFrame:
    """A line for each model: what its price was matched to, and where it comes from."""
    matched = F.when(F.col("source") == "fallback", "built-in fallback").otherwise(F.coalesce("matched", F.lit("no match")))
    return resolved.select(F.format_string("Pricing: %s -> %s (%s)", "model", matched, "source").alias("line")).orderBy("line")
