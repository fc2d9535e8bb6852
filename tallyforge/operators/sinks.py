"""Reports as JSON, CSV and text, composed in Spark; tables are rendered from the few rows of a finished report.

CSV reports are rows (part, place, line): part 0 is the header, 1 the rows in order, 2 a trailer. JSON reports are rows (place, json).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import hit_rate, saturated, total_tokens
from ..functions.scalars import compact, csv_field, grouped, money, percent
from ..plans.pricing import SYMBOLS, known_sum, provenance, strict_sum
from ..schema import TOKENS
from .ordered import numbered

#: How the token columns of a report are called outside.
SHOWN = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_tokens", "cache_creation": "cache_creation_tokens", "cache_read": "cache_read_tokens"}


#: Of prices from a cache: its age and time, shown where they were used.
CACHE = ("pricing_cache_age_seconds", "pricing_cache_mtime_epoch_seconds")


def with_cache(rows: DataFrame, age_s: int | None, mtime_s: int | None) -> DataFrame:
    """Adds CACHE to rows with prices from a cache, if there is one."""
    if age_s is None:
        return rows
    used = F.col("pricing_source").isin("cache", "cache_stale", "mixed")
    return rows.select("*", *[F.when(used, F.lit(v).cast("long")).alias(c) for c, v in zip(CACHE, (age_s, mtime_s))])


def kind_of(proxy: Column, real: Column) -> Column:
    """real, estimated_proxy or mixed."""
    return F.when((proxy > 0) & (real > 0), "mixed").when(proxy > 0, "estimated_proxy").otherwise("real")


def rolled(rows: DataFrame, *keys: str, cost: str = "cost", cache_read: bool = True, more: tuple[Column, ...] = (), strict: bool = False, source: str = "catalogue") -> DataFrame:
    """One row for each key from priced rows by key and model: tokens, models, cost, where prices are from, estimates.

    breakdown has the rows by model. cost is the column to add up: cost, or real_cost to leave estimates out. Unknown costs are left
    out of a sum as long as any is known; if strict, one of them makes it unknown. Sums without rows are 0.
    """
    model = F.struct("model", *[F.col(a).alias(b) for a, b in SHOWN.items()], F.round(hit_rate(cache_read), 2).alias("cache_hit_rate"), total_tokens().alias("total_tokens"), F.col(cost).alias("cost"), "pricing_source")
    out = rows.groupBy(*keys).agg(
        *[F.coalesce(saturated(F.col(t)), F.lit(0)).alias(t) for t in (*TOKENS, "call_count")], F.array_sort(F.collect_set("model")).alias("models"),
        (strict_sum(cost) if strict else known_sum(cost)).alias("cost"), provenance(default=source).alias("pricing_source"), F.sum(F.when(F.col("estimated_cost") > 0, F.col("estimated_cost"))).alias("estimated_cost"),
        kind_of(F.sum("proxy_entries"), F.sum("real_entries")).alias("cost_kind"), F.collect_list(model).alias("breakdown"), *more,
    )
    return out.select("*", total_tokens().alias("total_tokens"), F.round(hit_rate(cache_read), 2).alias("cache_hit_rate"))


def _measures(some: dict[str, str] = SHOWN) -> list[Column]:
    return [*[F.col(a).alias(b) for a, b in some.items()], F.col("cache_hit_rate"), F.col("total_tokens")]


def _objects(rows: DataFrame, fields: list[Column], quality: DataFrame | None, order: list[Column], few: bool = False) -> DataFrame:
    """(place, json): estimates are told where there are any; data quality is told in each object, or alone in one if there are no rows."""
    priced = [*fields, F.col("cost"), F.col("pricing_source")]
    told = [F.col("cost_kind"), F.col("estimated_cost")]
    if quality is not None:
        rows = rows.crossJoin(F.broadcast(_told(quality)))  # one row
        last = [F.col("data_quality")]
    else:
        last = []
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    either = lambda *some: F.when(F.col("estimated_cost") > 0, text(*priced, *some, *told, *last)).otherwise(text(*priced, *some, *last))
    cache = [F.col(c) for c in CACHE if c in rows.columns]
    json = F.when(cache[0].isNotNull(), either(*cache)).otherwise(either()) if cache else either()
    out = numbered(rows, order, few).select("place", json.alias("json"))
    if quality is not None:
        alone = _told(quality).crossJoin(rows.agg(F.count("*").alias("n"))).where("n = 0")
        out = out.unionByName(alone.select(F.lit(1).cast("long").alias("place"), F.to_json(F.struct("data_quality")).alias("json")))
    return out


def _told(quality: DataFrame) -> DataFrame:
    return quality.select(F.struct(F.col("valid").alias("valid_entries"), F.col("dedup_skipped").alias("dedup_skipped_entries"), "parse_errors").alias("data_quality"))


def _order(key: list[str], descending: bool) -> list[Column]:
    return [F.col(k).desc() if descending else F.col(k).asc() for k in key]


def period_json(rows: DataFrame, label: str, breakdown: bool = False, quality: DataFrame | None = None, descending: bool = False, few: bool = False) -> DataFrame:
    """An object for each period, with its model names or, as a breakdown, its models by cost."""
    models = F.col("models")
    if breakdown:
        dear = lambda a, b: F.when(F.coalesce(a["cost"], F.lit(-1.0)) != F.coalesce(b["cost"], F.lit(-1.0)), F.when(F.coalesce(a["cost"], F.lit(-1.0)) > F.coalesce(b["cost"], F.lit(-1.0)), -1).otherwise(1)).when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0)
        models = F.array_sort("breakdown", dear).alias("breakdown")
    return _objects(rows, [F.col(label).cast("string").alias(label), *_measures(), models], quality, _order([label], descending), few)


def session_json(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, few: bool = False) -> DataFrame:
    order = [F.col("last_ms").desc_nulls_last() if descending else F.col("last_ms").asc_nulls_first(), *_order(["last_timestamp", "session_id", "session_key"], descending)]
    return _objects(rows, [F.col(c) for c in ("session_id", "project_path", "first_timestamp", "last_timestamp")] + [*_measures(), F.col("models")], quality, order, few)


def project_json(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, few: bool = False) -> DataFrame:
    return _objects(rows, [F.col(c) for c in ("project_name", "project_path", "session_count")] + [*_measures(), F.col("models")], quality, project_order(descending), few)


def project_order(descending: bool = False) -> list[Column]:
    """By cost; unknown cost is more than any."""
    cost = F.round("cost", 9)
    return [cost.desc_nulls_first() if descending else cost.asc_nulls_last(), F.col("project_path").asc()]


def block_json(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, few: bool = False) -> DataFrame:
    return _objects(rows, [F.col(c) for c in ("block_start", "block_end")] + [*_measures(), F.col("models")], quality, _order(["block_start", "block_end", "utc_offset"], descending), few)


def endpoint_json(rows: DataFrame, quality: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Endpoints in their order; they have no CSV form."""
    from ..functions.scalars import average_input, endpoint_order

    fields = [F.col("endpoint"), F.col("call_count").alias("calls"), *_measures(), average_input(F.col("input_tokens"), F.col("call_count")).alias("avg_input_per_call")]
    return _objects(rows, fields, quality, [endpoint_order(F.col("endpoint"))], few)


def csv_cost(c: Column) -> Column:
    """Six decimals, N/A if unknown."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.6f", F.round(c, 9)))  # sums differ in their last digits by the order of rows


def csv_rate(c: Column) -> Column:
    """Two decimals, nothing if there is none."""
    return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))  # format_string makes text of a null


def csv_report(rows: DataFrame, cells: dict[str, Column], order: list[Column], quality: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(part, place, line); cells are columns by header. A trailer tells data quality if lines were rejected."""
    cells = cells | {c: F.col(c).cast("string") for c in CACHE if c in rows.columns}
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(1).cast("long").alias("place"), F.lit(",".join(cells)).alias("line"))
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells.values()])
    out = head.unionByName(numbered(rows, order, few).select(F.lit(1).alias("part"), "place", line.alias("line")))
    if quality is not None:
        note = F.format_string("# data_quality valid=%d dedup_skipped=%d parse_errors=%d", "valid", "dedup_skipped", "parse_errors")
        out = out.unionByName(quality.where("parse_errors > 0").select(F.lit(2).alias("part"), F.lit(1).cast("long").alias("place"), note.alias("line")))
    return out


def _cells(names: tuple[str, ...], some: dict[str, str], estimates: bool) -> dict[str, Column]:
    out = {n: csv_field(F.col(n)) for n in names} | {b: csv_field(F.col(a)) for a, b in some.items()}
    out |= {"cache_hit_rate": csv_rate(F.col("cache_hit_rate")), "total_tokens": csv_field(F.col("total_tokens")), "cost": csv_cost(F.col("cost"))}
    if estimates:
        out |= {"cost_kind": F.col("cost_kind"), "estimated_cost": csv_cost(F.coalesce("estimated_cost", F.lit(0.0)))}
    return out | {"pricing_source": F.col("pricing_source")}


def period_csv(rows: DataFrame, label: str, quality: DataFrame | None = None, descending: bool = False, estimates: bool = False, few: bool = False) -> DataFrame:
    return csv_report(rows, _cells((label,), SHOWN, estimates), _order([label], descending), quality, few)


def period_breakdown_csv(rows: DataFrame, label: str, quality: DataFrame | None = None, descending: bool = False, few: bool = False) -> DataFrame:
    """A line for each model of a period, by name."""
    each = rows.select(label, F.inline("breakdown"))
    cells = {label: csv_field(F.col(label)), "model": csv_field(F.col("model"))} | {b: csv_field(F.col(b)) for b in SHOWN.values()}
    cells |= {"cache_hit_rate": csv_rate(F.col("cache_hit_rate")), "total_tokens": csv_field(F.col("total_tokens")), "cost": csv_cost(F.col("cost")), "pricing_source": F.col("pricing_source")}
    return csv_report(each, cells, [*_order([label], descending), F.col("model")], quality, few)


def session_csv(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, estimates: bool = False, few: bool = False) -> DataFrame:
    order = [F.col("last_ms").desc_nulls_last() if descending else F.col("last_ms").asc_nulls_first(), *_order(["last_timestamp", "session_id", "session_key"], descending)]
    return csv_report(rows, _cells(("session_id", "project_path", "first_timestamp", "last_timestamp"), SHOWN, estimates), order, quality, few)


def project_csv(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, estimates: bool = False, few: bool = False) -> DataFrame:
    some = {x: x for x in ("input_tokens", "output_tokens")}
    return csv_report(rows.withColumn("sessions", F.col("session_count")), _cells(("project_name", "project_path", "sessions"), some, estimates), project_order(descending), quality, few)


def block_csv(rows: DataFrame, quality: DataFrame | None = None, descending: bool = False, estimates: bool = False, few: bool = False) -> DataFrame:
    some = {a: b for a, b in SHOWN.items() if a != "reasoning_tokens"}
    return csv_report(rows, _cells(("block_start", "block_end"), some, estimates), _order(["block_start", "block_end", "utc_offset"], descending), quality, few)


def tools_csv(counts: DataFrame) -> DataFrame:
    """Tools by calls, and their total. counts: name, calls, share."""
    share = lambda c: F.format_string("%.1f", c)
    body = csv_report(counts, {"tool": csv_field(F.col("name")), "calls": csv_field(F.col("calls")), "percentage": share(F.col("share"))}, [F.desc("calls"), F.col("name")])
    total = counts.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).select(F.lit(2).alias("part"), F.lit(1).cast("long").alias("place"), F.format_string("Total,%d,100.0", "n").alias("line"))
    return body.unionByName(total)


def tools_json(counts: DataFrame) -> DataFrame:
    """One object: tools by calls and their total. There are as many tools as there are names of tools."""
    each = F.struct((-F.col("calls")).alias("o"), "name", F.struct("name", "calls", F.col("share").alias("percentage")).alias("t"))
    one = counts.agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["t"]).alias("tools"), F.coalesce(F.sum("calls"), F.lit(0)).alias("total"))
    return one.select(F.to_json(F.struct("tools", "total")).alias("json"))


def top_csv(rows: DataFrame, dimension: str) -> DataFrame:
    """rows: rank, the dimension, count, the sums, cost and share."""
    cells = {"rank": csv_field(F.col("rank")), dimension: csv_field(F.col(dimension)), "count": csv_field(F.col("count"))}
    cells |= {a: csv_field(F.col(a)) for a in ("input_tokens", "output_tokens", "cache_creation", "cache_read")} | {"cache_hit_rate": csv_rate(F.col("cache_hit_rate")), "reasoning_tokens": csv_field(F.col("reasoning_tokens")), "total_tokens": csv_field(F.col("tokens"))}
    cells |= {"share_percent": F.format_string("%.2f", "share"), "cost_usd": F.when(F.col("cost").isNull(), "N/A").otherwise(F.format_string("%.5f", F.round("cost", 9)))}
    return csv_report(rows, cells, [F.col("rank")], few=True)


def top_json(rows: DataFrame, dimension: str, limit: int) -> DataFrame:
    """One object with at most limit entries; total_rows is how many there were to rank."""
    fields = [F.col("rank"), F.col(dimension).alias("name"), F.col("count"), *[F.col(a) for a in ("input_tokens", "output_tokens", "cache_creation", "cache_read", "cache_hit_rate", "reasoning_tokens")], F.col("tokens").alias("total_tokens"), F.col("share").alias("share_percent"), F.round("cost", 5).alias("cost_usd")]
    one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("entries"), F.count("*").alias("displayed"), F.coalesce(F.min("share_basis"), F.lit("tokens")).alias("share_basis"), F.coalesce(F.max("total_rows"), F.lit(0)).alias("total_rows"))
    whole = F.struct(F.lit(dimension).alias("dimension"), F.lit(limit).alias("limit"), "displayed", "total_rows", "share_basis", "entries")
    return one.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


BUDGET = ("limit", "spent", "projected", "remaining", "used_pct", "projected_pct", "status", "days_elapsed", "days_in_month")


def budget_csv(months: DataFrame, descending: bool = False) -> DataFrame:
    """Months with their budget. months: rolled rows by month with the columns of forecast.monthly_budget and budget."""
    values = {"limit": F.col("budget"), "spent": F.col("cost")}
    number = lambda n: F.when(values.get(n, F.col(n) if n not in values else None).isNull(), "N/A").otherwise(F.format_string("%.6f", values.get(n, F.col(n) if n not in values else None)))
    cells = _cells(("month",), SHOWN, False) | {f"budget_{n}": number(n) if n not in ("status", "days_elapsed", "days_in_month") else F.col(n).cast("string") for n in BUDGET}
    return csv_report(months, cells, _order(["month"], descending), few=True)


def budget_json(months: DataFrame, descending: bool = False) -> DataFrame:
    """Months with an object budget."""
    number = lambda c: F.round(c, 6)
    budget = F.struct(number(F.col("budget")).alias("limit"), number(F.col("cost")).alias("spent"), *[number(F.col(c)).alias(c) for c in ("projected", "remaining", "used_pct", "projected_pct")], "status", "days_elapsed", "days_in_month")
    return _objects(months, [F.col("month"), *_measures(), F.col("models"), budget.alias("budget")], None, _order(["month"], descending), few=True)


def quota_rows(pace: DataFrame) -> DataFrame:
    """What a quota report shows of a row of forecast.quota_pace."""
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pace.where("error IS NULL").select(
        F.lit("codex").alias("source"), F.lit("weekly").alias("window"), "window_minutes", F.round("used_percent", 2).alias("used_pct"), F.round(F.greatest(100 - F.col("used_percent"), F.lit(0.0)), 2).alias("remaining_pct"),
        F.round("projected_percent", 2).alias("projected_pct_at_reset"), "status", at(F.col("observed_at")).alias("observed_at"), at(F.col("resets_at")).alias("resets_at"), at(F.col("depletes_at")).alias("estimated_depletion_at"),
        *([F.round("value", 2).alias("estimated_window_value_usd"), "value_error"] if "value" in pace.columns else []),
    )


def quota_json(pace: DataFrame) -> DataFrame:
    return quota_rows(pace).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def quota_csv(pace: DataFrame) -> DataFrame:
    rows = quota_rows(pace)
    numbers = ("used_pct", "remaining_pct", "projected_pct_at_reset", "estimated_window_value_usd")
    cells = {c: csv_rate(F.col(c)) if c in numbers else csv_field(F.col(c)) for c in rows.columns}
    return csv_report(rows, cells, [F.col("observed_at")], few=True)


def statusline_json(totals: DataFrame, label: str, quality: DataFrame | None = None) -> DataFrame:
    """One object of a rolled row without keys."""
    shown = F.struct(money(F.col("cost")).alias("cost"), compact(F.col("input_tokens")).alias("input"), compact(F.col("output_tokens")).alias("output"), compact(F.col("reasoning_tokens")).alias("reasoning"))
    fields = [F.lit(label).alias("source"), *_measures(), F.col("cost"), shown.alias("formatted")]
    rows = totals if quality is None else totals.crossJoin(F.broadcast(_told(quality)))
    return rows.select(F.to_json(F.struct(*fields, *([] if quality is None else ["data_quality"])), {"ignoreNullFields": "false"}).alias("json"))


def statusline_text(totals: DataFrame, label: str, code: str = "USD") -> DataFrame:
    """Source and cost, tokens in and out, cache hits."""
    text = F.concat_ws(" | ", F.concat(F.lit(f"{label}: "), money(F.col("cost"), SYMBOLS.get(code, f"{code} "))), F.concat(F.lit("In: "), compact(F.col("input_tokens")), F.lit(" Out: "), compact(F.col("output_tokens"))), F.concat(F.lit("Cache Hit: "), percent(F.col("cache_hit_rate"))))
    return totals.select(text.alias("line"))


FLAGS = {"has_projects": "projects", "has_billing_blocks": "blocks", "has_reasoning_tokens": "reasoning", "has_cache_creation": "cache_creation", "has_cache_read": "cache_read", "needs_dedup": "dedup"}


def source_rows(spark, registry) -> DataFrame:
    """All sources together, then each of them, with what they support."""
    names = ["all", *registry]
    found = [(n, registry.find(n)) for n in names]
    rows = [(i, n, s.label, list(s.aliases), *[getattr(s.capabilities, f) for f in FLAGS.values()]) for i, (n, s) in enumerate(found)]
    return spark.createDataFrame(rows, "place int, name string, display_name string, aliases array<string>, " + ", ".join(f"{f} boolean" for f in FLAGS))


def sources_csv(spark, registry) -> DataFrame:
    rows = source_rows(spark, registry)
    cells = {"name": F.col("name"), "display_name": csv_field(F.col("display_name")), "aliases": F.array_join("aliases", "|")} | {f: F.col(f).cast("string") for f in FLAGS}
    return csv_report(rows.withColumnRenamed("place", "n"), cells, [F.col("n")], few=True)


def sources_json(spark, registry) -> DataFrame:
    rows = source_rows(spark, registry)
    return rows.select(F.col("place").cast("long").alias("place"), F.to_json(F.struct("name", "display_name", "aliases", F.struct(*FLAGS).alias("capabilities"))).alias("json"))


def display(df: DataFrame, keys: list[str], language: str = "en", short: bool = False, code: str = "USD") -> DataFrame:
    """Columns as people read them."""
    number = (lambda c: compact(c)) if short else (lambda c: grouped(c, language))
    counts = [c for c in ("input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning_tokens", "call_count") if c in df.columns]
    shown: list[Column] = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    shown += [number(F.col(c)).alias(c) for c in counts] + [number(total_tokens()).alias("total_tokens"), percent(hit_rate()).alias("hit_rate")]
    return df.select(*shown, *([money(F.col("cost"), SYMBOLS.get(code, f"{code} ")).alias("cost")] if "cost" in df.columns else []))


def with_total_row(rows: DataFrame, key: str | None) -> DataFrame:
    """Rolled rows with a last row TOTAL, whose cost is unknown as soon as one is. The key becomes text; part is 0 for rows and 1 for the total."""
    whole = rows.agg(*[F.coalesce(saturated(F.col(t)), F.lit(0)).alias(t) for t in (*TOKENS, "call_count")], strict_sum("cost").alias("cost"))
    names = [c for c in rows.columns if c not in (*TOKENS, "call_count", "cost", "breakdown", "models")]
    kept = [*TOKENS, "call_count", "cost"]
    text = [F.col(c).cast("string").alias(c) for c in names]
    last = [F.lit("TOTAL" if c == key else None).cast("string").alias(c) for c in names]
    each = rows.select(F.lit(0).alias("part"), *text, *kept) if key is not None else rows.limit(0).select(F.lit(0).alias("part"), *text, *kept)
    return each.unionByName(whole.select(F.lit(1).alias("part"), *last, *kept))


def with_models(rows: DataFrame, each: DataFrame, cost: str, names: list[str]) -> DataFrame:
    """Rows of with_total_row, and after each those of its models. names are its keys and model, which is null where a row is a sum."""
    keys, kept = names[:-1], [*TOKENS, "call_count"]
    if not keys:
        rows = rows.withColumn("model", F.lit("TOTAL"))
    else:
        rows = rows.withColumn("model", F.lit(None).cast("string"))
    parts = each.select("part", *[F.col(k).cast("string").alias(k) for k in keys], F.col("model"), *kept, F.col(cost).alias("cost"))
    return rows.select("part", *names, *kept, "cost").unionByName(parts)


def top_table(rows: DataFrame, dimension: str) -> DataFrame:
    """A ranking as people read it."""
    share = F.format_string("%.2f%%", "share")
    return rows.orderBy("rank").select("rank", dimension, grouped(F.col("count")).alias("count"), grouped(F.col("tokens")).alias("tokens"), money(F.col("cost")).alias("cost"), share.alias("share"))


def tools_table(counts: DataFrame) -> DataFrame:
    """Tools by calls, and their total."""
    whole = counts.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).select(F.lit(1).alias("part"), F.lit("TOTAL").alias("name"), "calls", F.lit(100.0).alias("share"))
    rows = counts.select(F.lit(0).alias("part"), "name", "calls", "share").unionByName(whole).orderBy("part", F.desc("calls"), "name")
    return rows.select(F.col("name").alias("tool"), grouped(F.col("calls")).alias("calls"), F.format_string("%.1f%%", "share").alias("share"))


def budget_table(months: DataFrame) -> DataFrame:
    """Months against a budget as people read them. months: as for budget_csv."""
    percents = [F.coalesce(F.format_string("%.1f%%", c), F.lit("N/A")).alias(c) for c in ("used_pct", "projected_pct")]
    amounts = [money(F.col(a)).alias(b) for a, b in (("cost", "spent"), ("budget", "budget"), ("projected", "projected"), ("remaining", "remaining"))]
    return months.orderBy("month").select("month", *amounts, *percents, "status")


def quota_table(pace: DataFrame) -> DataFrame:
    """A quota as rows of names and values."""
    rows = quota_rows(pace)
    return rows.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for c in rows.columns])).alias("n", "e")).orderBy("n").select("e.name", "e.value")


def text_table(df: DataFrame, limit: int = 1000) -> str:
    """A finished report as aligned text; at most limit rows, and a note if there are more."""
    rows = [list(map(str, r)) for r in df.limit(limit + 1).collect()]
    more, rows = len(rows) > limit, [df.columns, *rows[:limit]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) if not i else x.rjust(w) for i, (x, w) in enumerate(zip(r, width))).rstrip() for r in rows]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:], *(["..."] if more else [])])
