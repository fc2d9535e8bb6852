"""The library's front door: usage summaries, quota and the value of a quota window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.measures import cost_kind, hit_rate, saturated, total_tokens
from .functions.scalars import project_name, zone_name
from .operators import dedup, files, ordered, reports, sinks
from .operators.intervals import Cuts
from .plans import forecast, pricing
from .schema import COLUMNS, TOKENS
from .sources import SOURCES, claude, codex
from .sources.base import ALL
from .staging import staged


@dataclass(frozen=True)
class Range:
    """Inclusive dates; either side may be open."""

    since: date | None = None
    until: date | None = None

    def __post_init__(self):
        if self.since and self.until and self.since > self.until:
            raise ValueError("since is after until")

    @classmethod
    def today(cls, as_of: date) -> Range:
        return cls(as_of, as_of)

    @classmethod
    def this_week(cls, as_of: date) -> Range:
        return cls(as_of - timedelta(days=as_of.weekday()), as_of)

    @classmethod
    def this_month(cls, as_of: date) -> Range:
        return cls(as_of.replace(day=1), as_of)


PERIODS = {"daily": lambda days: days, "today": lambda days: days, "weekly": reports.weekly, "monthly": reports.monthly}
KEYS = {"daily": "date", "today": "date", "weekly": "week", "monthly": "month"}
#: Reports that all sources together give.
TOGETHER = (*PERIODS, "models", "statusline")
#: What sums by model need of a fact.
MEASURED = ("model", *TOKENS, "call_count", "cost_kind", "recorded_cost_usd")


def _grain(*keys: str):
    """Sums of counted rows by keys and model."""
    return lambda rows, zone: reports.by(rows, *keys, "model", "rejected", more=tuple(reports.counters()))


def _session_grain(rows: DataFrame, zone: str) -> DataFrame:
    return reports.session_parts(rows, "rejected", told=tuple(reports.counters()))


def _block_grain(rows: DataFrame, zone: str) -> DataFrame:
    return reports.by(reports.with_block(rows, zone), "block_start", "utc_offset", "model", "rejected", more=tuple(reports.counters()))


_SESSION = ("session_id", "project_path", "timestamp")
#: Of each report: keys, the columns that it needs besides MEASURED, and its finest sums.
GRAINS = {
    **{kind: ((key,), ("date",), _grain("date")) for kind, key in KEYS.items()},
    **{kind: ((), ("date",), _grain("date")) for kind in ("models", "statusline")},
    "session": (("session_key", "session_id", "project_path", "first_timestamp", "last_timestamp", "last_ms"), _SESSION, _session_grain),
    "project": (("project_path",), _SESSION, _session_grain),
    "blocks": (("block_start", "block_end", "utc_offset"), (), _block_grain),
    "endpoints": (("endpoint",), ("endpoint",), _grain("endpoint")),
}


@dataclass(frozen=True)
class Loaded:
    """Usage facts of a source: all in the range, and those that count, with entries and with rejected lines as dedup.counted tells them."""

    every: DataFrame
    counted: DataFrame

    @property
    def facts(self) -> DataFrame:
        """The facts that count."""
        return self.counted.where("NOT rejected").drop("rejected", "entries")

    @property
    def quality(self) -> DataFrame:
        """One row with valid, dedup_skipped and parse_errors."""
        return dedup.quality_of(self.counted)


def loaded(
    spark: SparkSession, source: str, root: str | dict[str, str], zone: str = "UTC", wanted: Range = Range(), columns: tuple[str, ...] = tuple(COLUMNS), options: dict | None = None, **more
) -> Loaded:
    """Facts filtered by date and then deduplicated as the source asks; of all sources (root by name) each by itself.

    Only columns, and what dedup looks at, are carried. Options are those of the source's scan; for all sources, options has them by name.
    """
    found, zone = SOURCES.find(source), zone_name(zone)
    if found.name == ALL:
        parts = [loaded(spark, name, path, zone, wanted, columns, **(options or {}).get(SOURCES.find(name).name, {})) for name, path in root.items()]
        if not parts:
            raise ValueError("all sources need a root each, by name")
        return Loaded(*(reduce(DataFrame.unionByName, (getattr(p, f) for p in parts)) for f in ("every", "counted")))
    if more.get("scope", "all") != "all" and found.name != "codex":
        raise ValueError("only codex has scopes")
    if found.capabilities.ranged:
        more["wanted"] = (wanted.since, wanted.until)
    rows = found.scan(spark, root, zone, **more).select(*dict.fromkeys((*dedup.IDENTITY, "date", *columns)), "rejected")
    rows = reports.in_range(rows, wanted.since, wanted.until, always=F.col("rejected"))
    best = dedup.counted(rows) if found.capabilities.dedup else rows.withColumn("entries", F.lit(1).cast("long"))
    return Loaded(rows.where("NOT rejected").drop("rejected"), best)


def facts(spark: SparkSession, source: str, root: str | dict[str, str], zone: str = "UTC", wanted: Range = Range(), **options) -> DataFrame:
    """The usage facts that count."""
    return loaded(spark, source, root, zone, wanted, **options).facts


@dataclass(frozen=True)
class Report:
    """A report of a source. cost names the column that it adds up: estimates are left out of all sources.

    told is the only plan that reads logs: sums at the finest grain that the report needs, with rejected lines and COUNTERS. It runs
    once, when something is first asked of the report; all else is made from its staged result.
    """

    kind: str
    keys: tuple[str, ...]
    told: DataFrame
    prices: pricing.Prices
    strict: bool
    label: str
    cost: str = "cost"
    cache_read: bool = True
    currency: pricing.Currency = pricing.Currency()

    @cached_property
    def sums(self) -> DataFrame:
        """told, staged."""
        return staged(self.told, "report")

    @cached_property
    def few(self) -> bool:
        """Whether one task may put the rows in order."""
        return self.sums.count() <= ordered.FEW

    @cached_property
    def quality(self) -> DataFrame:
        """One row with valid, dedup_skipped and parse_errors."""
        return reports.quality(self.sums)

    @cached_property
    def base(self) -> DataFrame:
        """The sums with their costs, at the grain of told."""
        rows = self.sums.where("NOT rejected").drop("rejected", *reports.COUNTERS)
        return self._priced(rows)

    def _priced(self, rows: DataFrame) -> DataFrame:
        """Rows by model with their costs, in the currency of the report."""
        priced = pricing.with_costs(rows, pricing.resolve(self.sums.where("NOT rejected"), self.prices, self.strict))
        if self.currency.rate == 1:
            return priced
        return priced.withColumns({c: F.col(c) * self.currency.rate for c in ("cost", "real_cost", "estimated_cost")})

    @cached_property
    def rows(self) -> DataFrame:
        """Sums and costs by keys and model."""
        rows = self.sums.where("NOT rejected").drop("rejected", *reports.COUNTERS)
        if self.kind in PERIODS:
            rows = PERIODS[self.kind](rows)
        elif self.kind in ("models", "statusline"):
            rows = reports.models(rows)
        elif self.kind == "session":
            rows = reports.session_whole(rows)
        elif self.kind == "project":
            rows = reports.project_models(reports.session_whole(rows))
        elif self.kind == "blocks":
            rows = with_block_times(rows)
        priced = self._priced(rows)
        return priced.select(*self.keys, "model", *[c for c in priced.columns if c not in (*self.keys, "model", "rates")])

    def rolled(self, breakdown: bool = False) -> DataFrame:
        """One row for each key. In a breakdown one unknown model makes the cost unknown; in a status line, a day of nothing else."""
        if self.kind == "statusline":
            days = sinks.rolled(self.base, "date", cost=self.cost).select("date", F.col("cost").alias("day_cost"))
            cost = days.agg(pricing.strict_sum("day_cost").alias("cost"))
            whole = sinks.rolled(self.rows, cache_read=self.cache_read, source=self.prices.source).drop("cost")
            return self._with_cache(whole.crossJoin(F.broadcast(cost)))  # one row each
        more = (F.sum("session_rows").alias("session_count"),) if self.kind == "project" else ()
        out = sinks.rolled(self.rows, *self.keys, cost=self.cost, cache_read=self.cache_read, more=more, strict=breakdown, source=self.prices.source)
        out = self._with_cache(out)
        return out.withColumn("project_name", project_name(F.col("project_path"))) if self.kind == "project" else out

    def json(self, breakdown: bool = False, descending: bool = False) -> DataFrame:
        """(place, json)"""
        rows = self.rolled(breakdown)
        if self.kind in PERIODS:
            return sinks.period_json(rows, self.keys[0], breakdown, self.quality, descending, few=self.few)
        if self.kind == "statusline":
            return sinks.statusline_json(rows, self.label, self.quality).select(F.lit(1).cast("long").alias("place"), "json")
        if self.kind == "endpoints":
            return sinks.endpoint_json(rows, self.quality, few=self.few)
        made = {"session": sinks.session_json, "project": sinks.project_json, "blocks": sinks.block_json}
        if self.kind not in made:
            raise ValueError(f"{self.kind} has no JSON form of its own")
        return made[self.kind](rows, self.quality, descending, few=self.few)

    def csv(self, breakdown: bool = False, descending: bool = False, estimates: bool = False) -> DataFrame:
        """(part, place, line)"""
        rows = self.rolled()
        if self.kind in PERIODS:
            if breakdown:
                return sinks.period_breakdown_csv(rows, self.keys[0], self.quality, descending, few=self.few)
            return sinks.period_csv(rows, self.keys[0], self.quality, descending, estimates, few=self.few)
        made = {"session": sinks.session_csv, "project": sinks.project_csv, "blocks": sinks.block_csv}
        if self.kind not in made:
            raise ValueError(f"{self.kind} has no CSV form")
        return made[self.kind](rows, self.quality, descending, estimates, few=self.few)

    def _with_cache(self, rows: DataFrame) -> DataFrame:
        return sinks.with_cache(rows, self.prices.age_s, self.prices.mtime_s)

    def table(self, short: bool = False, limit: int = 1000, breakdown: bool = False) -> str:
        """Aligned text of at most limit rows, in order, with a total and, if lines were rejected, a note; a status line is one line."""
        if self.kind == "statusline":
            return sinks.statusline_text(self.rolled(), self.label, self.currency.code).first()["line"]
        names = [k for k in self.keys if k != "last_ms"] if self.kind != "models" else []
        each = self.rows.withColumn("part", F.lit(0)) if breakdown or self.kind == "models" else None
        rows = sinks.with_total_row(self.rolled(), names[0] if names else None)
        if each is not None:
            names = [*names, "model"]
            rows = sinks.with_models(rows, each, self.cost, names)
        rows = rows.orderBy("part", *[F.col(c).asc_nulls_first() for c in names])
        note = self.quality.first()
        text = sinks.text_table(sinks.display(rows, names, short=short, code=self.currency.code), limit)
        return text + (f"\n{note['parse_errors']} lines could not be read" if note["parse_errors"] else "")

    def save(self, path: str, format: str = "csv", **options) -> str:
        """One readable file: csv, json (an array with an object a line) or table; options are those of the method of that name."""
        made = {"csv": self.csv, "json": lambda **o: files.json_lines(self.json(**o)), "table": lambda **o: files.text_lines(self.table(**o), self.told.sparkSession)}
        if format not in made:
            raise ValueError(f"format must be one of {', '.join(made)}")
        return files.saved(made[format](**options), path)


def usage_report(
    spark: SparkSession, kind: str, source: str, root: str | dict[str, str], prices: pricing.Prices | DataFrame, wanted: Range = Range(), zone: str = "UTC", strict: bool = False,
    currency: pricing.Currency = pricing.Currency(), **options,
) -> Report:
    """daily, today, weekly, monthly, session, project, blocks, endpoints, models or statusline, with costs."""
    found, zone = SOURCES.find(source), zone_name(zone)
    can = found.capabilities
    if found.name == ALL and kind not in TOGETHER:
        raise ValueError(f"all sources together give {', '.join(TOGETHER)}; name one source for {kind}")
    if {"project": not can.projects, "endpoints": not can.endpoints, "blocks": not can.blocks}.get(kind, False):
        raise ValueError(f"{source} does not support {kind}")
    if kind not in GRAINS:
        raise ValueError(f"no report {kind!r}")
    keys, columns, sums = GRAINS[kind]
    got = loaded(spark, source, root, zone, wanted, (*MEASURED, *columns), **options)
    told = sums(got.counted, zone)
    return Report(kind, keys, told, pricing.Prices.of(prices), strict, found.label, "real_cost" if found.name == ALL else "cost", can.cache_read, currency)


def with_block_times(rows: DataFrame) -> DataFrame:
    """Start and end of blocks as text with their UTC offset."""
    away = F.abs("utc_offset")
    offset = F.concat(F.when(F.col("utc_offset") < 0, "-").otherwise("+"), F.lpad(F.floor(away / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((away % 60).cast("string"), 2, "0"))
    at = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(" "), offset)
    return rows.withColumn("block_end", at(F.col("block_start") + F.expr(f"INTERVAL {reports.BLOCK_HOURS} HOURS"))).withColumn("block_start", at(F.col("block_start")))


def report(spark: SparkSession, kind: str, source: str, root: str | dict[str, str], prices: DataFrame, wanted: Range = Range(), zone: str = "UTC", strict: bool = False, **options) -> DataFrame:
    """The rows of usage_report by key and model, or the counts of tools."""
    if kind == "tools":
        return tools(spark, source, root, wanted, zone)
    return usage_report(spark, kind, source, root, prices, wanted, zone, strict, **options).rows


def tools(spark: SparkSession, source: str, root: str, wanted: Range = Range(), zone: str = "UTC") -> DataFrame:
    """Distinct tool calls by name. Calls without a date are in no range, an open one included."""
    if not SOURCES.find(source).capabilities.tools:
        raise ValueError(f"{source} has no tool calls")
    calls = claude.tool_calls(spark, root, zone_name(zone))
    return reports.tool_counts(dedup.distinct_tool_calls(reports.in_range(calls, wanted.since or "0001-01-01", wanted.until)))


def top(spark: SparkSession, dimension: str, source: str, root: str | dict[str, str], prices: DataFrame, limit: int = 10, wanted: Range = Range(), zone: str = "UTC", strict: bool = False) -> DataFrame:
    """Models or projects by cost: rank, name, count of calls or sessions, tokens, share of what is shown, and how many there are in all."""
    if dimension not in ("model", "project"):
        raise ValueError("top ranks by model or project")
    kind = {"model": "models", "project": "project"}[dimension]
    got = usage_report(spark, kind, source, root, prices, wanted, zone, strict)
    key = {"model": "model", "project": "project_path"}[dimension]
    more = (F.sum("session_rows").alias("count"),) if dimension == "project" else (F.sum("call_count").alias("count"),)
    rows = sinks.rolled(got.rows, key, cost=got.cost, cache_read=got.cache_read, more=more)
    whole = rows.agg(F.count("*").alias("total_rows"))  # one row; all of this comes from the staged sums
    return reports.top(rows.withColumn("tokens", F.col("total_tokens")), key, limit).crossJoin(F.broadcast(whole))


def budget(spark: SparkSession, source: str, root: str | dict[str, str], prices: DataFrame, limit: float, as_of: date, wanted: Range = Range(), zone: str = "UTC", strict: bool = False) -> DataFrame:
    """Months against a budget; the month of as_of (no later than the end of the range) is projected."""
    months = usage_report(spark, "monthly", source, root, prices, wanted, zone, strict).rolled()
    day = min(as_of, wanted.until) if wanted.until else as_of
    return forecast.monthly_budget(months, limit, day.isoformat()).withColumn("budget", F.lit(float(limit)))


def summarize(spark: SparkSession, source: str, root: str | dict[str, str], prices: DataFrame, wanted: Range, zone: str = "UTC", strict: bool = False, **options) -> DataFrame:
    """One row with totals, cost, the models by cost and data quality; without usage all sums are 0."""
    got = usage_report(spark, "models", source, root, prices, wanted, zone, strict, **options)
    return _summary(got.rows, cost=got.cost).crossJoin(got.quality)  # one row each


_SUMMED = ("input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning_tokens", "call_count")


def _summary(rows: DataFrame, *keys: str, cost: str = "cost") -> DataFrame:
    """Totals, cost and the models by falling cost, by keys. Rows with a null model stand for keys without usage."""
    used = F.col("model").isNotNull()
    row = F.struct("model", F.col(cost).alias("cost"), total_tokens().alias("total_tokens"), cost_kind().alias("cost_kind"))
    model = F.struct(F.col(cost).isNull().alias("unknown"), (-F.coalesce(cost, F.lit(0.0))).alias("order"), (-total_tokens()).alias("size"), row.alias("m"))
    has = used & F.coalesce(pricing.has_cost_input(), F.lit(False))
    total = rows.groupBy(*keys).agg(
        *[F.coalesce(saturated(F.col(n)), F.lit(0)).alias(n) for n in _SUMMED], pricing.known_sum(cost, has).alias("cost"), pricing.provenance().alias("pricing_source"),
        F.transform(F.sort_array(F.collect_list(F.when(used, model))), lambda x: x["m"]).alias("models"),
    )
    return total.select(*keys, *_SUMMED, total_tokens().alias("total_tokens"), hit_rate().alias("hit_rate"), "cost", "pricing_source", "models")


def summarize_ranges(
    spark: SparkSession, source: str, root: str | dict[str, str], prices: DataFrame, wanted: dict[str, Range], zone: str = "UTC", strict: bool = False, options: dict | None = None, **more
) -> DataFrame:
    """A row for each named range, in the order asked for (position), from one pass over the logs; equal to one call of summarize for each.

    What is shuffled does not grow with the number of ranges; see operators.intervals.
    """
    found, zone = SOURCES.find(source), zone_name(zone)
    cuts = Cuts([(n, r.since, r.until) for n, r in wanted.items()])
    roots = root if found.name == ALL else {found.name: root}
    parts = []
    for name, path in roots.items():
        one = SOURCES.find(name)
        rows = one.scan(spark, path, zone, **((options or {}).get(one.name, {}) if found.name == ALL else more))
        rows = rows.select(*dict.fromkeys((*dedup.IDENTITY, "date", *MEASURED)), "rejected")
        parts.append(cuts.sums(rows, MEASURED, one.capabilities.dedup))
    if not parts:
        raise ValueError("all sources need a root each, by name")
    sums = staged(reduce(DataFrame.unionByName, parts), "ranges")
    errors = sums.agg(F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("parse_errors"))
    told, quality = cuts.merged(sums.where("NOT rejected"))
    every = cuts.table(spark).select("position", "range_id")
    priced = pricing.costed(told, prices, strict)
    rows = every.join(priced, ["position", "range_id"], "left")
    out = _summary(rows, "position", "range_id", cost="real_cost" if found.name == ALL else "cost")
    return out.join(quality, ["position", "range_id"]).crossJoin(F.broadcast(errors)).orderBy("position")  # a row for each range, and one


def quota_report(spark: SparkSession, root: str, now_s: int, prices: pricing.Prices | DataFrame | None = None, strict: bool = False, currency: str = "USD") -> DataFrame:
    """The weekly quota in one row; with prices also what the whole window is worth, in dollars only. Raises QuotaError where there is none."""
    if currency.strip().upper() != "USD":
        raise ValueError("a quota is valued in USD only")
    pace = staged(weekly_quota(spark, root, now_s), "quota")
    problem = pace.first()["error"]
    if problem is not None:
        raise QuotaError(problem)
    if prices is None:
        return pace
    value = weekly_value(spark, root, prices, now_s, strict)
    return pace.crossJoin(F.broadcast(value.select("value", F.col("error").alias("value_error"))))  # one row each


def weekly_quota(spark: SparkSession, root: str, now_s: int | None) -> DataFrame:
    """The newest weekly quota and where it is heading, in one row; error says why that cannot be told. Without now_s all files count, and no limit is too old."""
    return forecast.quota_pace(codex.quota_snapshot(spark, root, now_s), None if now_s is None else F.lit(now_s).cast("long"))


class QuotaError(ValueError):
    """No quota can be told; kind is the error of weekly_quota, or parse_errors."""

    def __init__(self, kind: str):
        super().__init__(f"no weekly quota: {kind}")
        self.kind = kind


def weekly_value(spark: SparkSession, root: str, prices: DataFrame, now_s: int | None, strict: bool = False) -> DataFrame:
    """What the whole quota window is worth at the pace so far; the reason if that cannot be told."""
    quota = weekly_quota(spark, root, now_s).first()
    if quota["error"] is not None:
        raise QuotaError(quota["error"])
    rows = codex.scan(spark, root, missing_model="unknown-model")
    if not rows.where("rejected").isEmpty():
        raise QuotaError("parse_errors")
    start, end = (quota["resets_at"] - quota["window_minutes"] * 60) * 1000, quota["observed_at"] * 1000
    rows = rows.where(F.col("timestamp_ms").between(start, end)).drop("rejected")
    sums = reports.by(dedup.best_candidate(rows), "model")
    sums = pricing.with_costs(sums, pricing.resolve(rows, prices, strict))
    usage = sums.agg(F.sum(total_tokens()).alias("tokens"), pricing.known_sum().alias("cost"), F.collect_set(F.when(F.col("pricing_source") == "unknown", F.col("model"))).alias("unpriced"))
    return forecast.window_value(usage, F.lit(float(quota["used_percent"])))
