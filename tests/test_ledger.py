"""The ledger library on hand-made rows, and its invariants."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge import api
from tallyforge.functions import measures, scalars
from tallyforge.operators import dedup, ordered, reports, sinks
from tallyforge.plans import forecast, pricing
from tallyforge.schema import RATES, USAGE


def facts(spark, *rows):
    """Usage rows from (message_id, stop, ms, input, output) and overrides."""
    base = dict(source="t", timestamp="", session_key="s", session_id="s", project_path="/p", model="claude-sonnet-4", cost_kind="real", endpoint="native", call_count=1, file_path="f", date=date(2024, 1, 1))
    names = [x.split()[0] for x in USAGE.split(", ")]
    zero = dict.fromkeys(("input_tokens", "output_tokens", "cache_creation", "cache_creation_1h", "cache_read", "reasoning_tokens"), 0)
    made = []
    for i, (mid, stop, ms, inp, out, *more) in enumerate(rows):
        row = zero | base | dict(message_id=mid, stop_reason=stop, timestamp_ms=ms, input_tokens=inp, output_tokens=out, line_ord=i) | (more[0] if more else {})
        made.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(made, USAGE)


def test_best_candidate_rules(spark):
    df = facts(
        spark, ("a", None, 1, 50, 0), ("a", "end", 2, 100, 0), ("a", None, 9, 999, 0), ("b", None, 1, 1, 0), ("b", None, 3, 3, 0), ("c", "end", 5, 7, 0), ("c", "end", 5, 8, 0),
        (None, "end", 1, 11, 0), (None, None, 1, 12, 0), ("d", "", 1, 13, 0), ("d", None, 2, 14, 0), ("a", "end", 1, 21, 0, {"session_key": "z"}),
        ("source-wide:x", "end", 1, 31, 0), ("source-wide:x", "end", 2, 32, 0, {"session_key": "z"}),
    )
    best = dedup.best_candidate(df)
    assert sorted(r["input_tokens"] for r in best.collect()) == [3, 7, 11, 13, 21, 32, 100]
    assert dedup.quality_of(dedup.counted(df)).first().asDict() == {"valid": 7, "dedup_skipped": 6, "parse_errors": 0}


def test_dedup_does_not_depend_on_order_or_partitions(spark):
    r = random.Random(1)
    rows = [(f"m{r.randint(0, 40)}", r.choice([None, "end"]), r.randint(0, 5), i, 0) for i in range(300)]
    df = facts(spark, *rows)
    want = sorted(map(tuple, dedup.best_candidate(df).collect()), key=str)
    for n in (1, 7):
        assert sorted(map(tuple, dedup.best_candidate(df.repartition(n, F.rand(3))).collect()), key=str) == want


def test_measures(spark):
    df = facts(spark, ("a", "e", 1, 10, 5), ("b", "e", 1, 7, 0, {"cost_kind": "estimated_proxy"}), ("c", "e", 1, 1, 1, {"recorded_cost_usd": -2.0}), ("d", "e", 1, 1, 1, {"recorded_cost_usd": 0.5}))
    row = reports.by(df, "model").select("*", measures.cost_kind().alias("kind"), measures.hit_rate().alias("rate"), measures.hit_rate(False).alias("none")).first()
    assert (row["input_tokens"], row["priced_input_tokens"], row["est_input_tokens"], row["recorded_usd"], row["recorded_entries"], row["kind"], row["rate"], row["none"]) == (19, 17, 7, 0.5, 2, "mixed", 0.0, None)
    big = facts(spark, *[("x", "e", 1, 2**63 - 1, 0)] * 2)
    row = measures.with_cost_parts(big).agg(*measures.sums()).select("*", measures.total_tokens().alias("total")).first()
    assert row["input_tokens"] == row["total"] == 2**63 - 1
    assert measures.with_cost_parts(big.limit(0)).agg(*measures.sums()).first()["input_tokens"] is None


def test_blocks_restart_at_midnight(spark):
    hour = 3600 * 1000
    df = facts(spark, *[(str(i), "e", int(h * hour), 1, 0) for i, h in enumerate((10, 14.5, 15, 20, 23.9, 24))])
    got = [(str(r["block_start"]), r["label"], r["input_tokens"]) for r in reports.blocks(df).orderBy("block_start").collect()]
    assert [(b[11:16], label, n) for b, label, n in got] == [("10:00", "10:00-15:00", 2), ("15:00", "15:00-20:00", 1), ("20:00", "20:00-01:00", 2), ("00:00", "00:00-05:00", 1)]


def test_sessions_and_projects(spark):
    df = facts(spark, ("a", "e", 5, 1, 0, {"timestamp": "t5"}), ("b", "e", 2, 2, 0, {"timestamp": "t2", "project_path": "/q"}), ("c", "e", 3, 4, 0, {"session_key": "z", "project_path": "/q", "timestamp": "t3"}))
    rows = reports.sessions(df)
    one = {r["session_key"]: r for r in rows.collect()}["s"]
    assert (one["project_path"], one["first_timestamp"], one["last_timestamp"], one["input_tokens"]) == ("/p", "t2", "t5", 3)
    assert {r["project_path"]: (r["session_count"], r["input_tokens"]) for r in reports.projects(rows).collect()} == {"/p": (1, 3), "/q": (1, 4)}


def test_top_shares_and_unknown_cost(spark):
    rows = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 9), ("c", None, 100)], "model string, cost double, tokens long")
    assert [(r["model"], r["rank"], r["share"]) for r in reports.top(rows, "model", 2).collect()] == [("a", 1, 75.0), ("b", 2, 25.0)]
    assert [(r["model"], r["share"]) for r in reports.top(rows, "model").collect()] == [("a", 0.91), ("b", 8.18), ("c", 90.91)]
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            reports.top(rows, "model", bad)


def test_sum_of_deltas_is_the_total(spark):
    r, rows = random.Random(2), []
    for k in range(5):
        total = 0
        for i in range(60):
            total += r.choice([0, 0, r.randint(1, 9)])
            rows.append((k, i, total))
    df = spark.createDataFrame(rows, "k int, i int, n long").repartition(5)
    got = ordered.cumulative_delta(df, ["k"], ["i"], ["n"]).groupBy("k").agg(F.sum("delta_n").alias("d")).collect()
    assert {r["k"]: r["d"] for r in got} == {k: max(n for q, _, n in rows if q == k) for k in range(5)}


def test_places_and_running_sums(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 9) if r.random() < 0.9 else None, i, r.randint(0, 5)) for i in range(500)]
    got = ordered.placed(spark.createDataFrame(rows, "k int, i int, n long").repartition(7), [F.col("k").asc_nulls_last(), F.col("i").desc()], n=F.col("n")).collect()
    want, before = {}, 0
    for place, (_, i, n) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -x[1])), 1):
        want[i], before = (place, before), before + n
    assert {x["i"]: (x["place"], x["before_n"]) for x in got} == want
    assert ordered.placed(spark.range(0), [F.col("id")]).count() == 0


@pytest.fixture(scope="module")
def prices(spark):
    costs = {"claude-sonnet-4": (3e-6, 15e-6), "claude-opus-4-20250101": (1.0, 2.0), "claude-opus-4-20250202": (1.0, 2.0), "openai/gpt-5": (1e-6, 2e-6), "zai/glm-5.2": (5.0, 5.0), "host/glm-5p2": (6.0, 6.0), "mistral": (1.0, 1.0), "gpt-0": (None, None), "xai/grok-build-0.1": (9.0, 9.0)}
    fields = "input_cost_per_token double, output_cost_per_token double, reasoning_output_cost_per_token double, reasoning_cost_per_token double, cache_creation_input_token_cost double, cache_creation_input_token_cost_above_1hr double, cache_read_input_token_cost double"
    raw = spark.createDataFrame([(n, (i, o, None, None, None, None, None)) for n, (i, o) in costs.items()], f"name string, costs struct<{fields.replace(' double', ':double')}>")
    return pricing.catalogue(raw)


def test_catalogue_aliases(prices):
    got = {r["price_key"]: r["input"] for r in prices.collect()}
    assert got["sonnet-4"] == 3e-6 and got["gpt-5"] == 1e-6 and got["glm-5.2"] == 5.0 and got["grok-build"] == 9.0
    assert "mistral" not in got and "gpt-0" not in got and got["host/glm-5p2"] == 6.0


def test_resolution_is_conservative(spark, prices):
    names = ["claude-sonnet-4", "anthropic.claude-sonnet-4", "Claude-Sonnet-4-20991231", "claude-opus-4", "gpt-5-2025-08-07", "sonnet", "my-gpt-5-copy", "", "nothing"]
    got = {r["model"]: r for r in pricing.resolve(spark.createDataFrame([(n,) for n in names], "model string"), prices).collect()}
    assert {m: (r["stage"], r["rates"] is not None) for m, r in got.items()} == {
        "claude-sonnet-4": (1, True), "anthropic.claude-sonnet-4": (2, True), "Claude-Sonnet-4-20991231": (3, True), "claude-opus-4": (4, False),
        "gpt-5-2025-08-07": (3, True), "sonnet": (None, False), "my-gpt-5-copy": (None, False), "nothing": (None, False),
    }
    loose = {r["model"]: r["source"] for r in pricing.resolve(spark.createDataFrame([("sonnet",), ("nothing",), ("claude-opus-4",)], "model string"), prices, strict=False).collect()}
    assert loose == {"sonnet": "fallback", "nothing": "unknown", "claude-opus-4": "fallback"}


def test_roll_ups_of_unknown_cost(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", None, True), ("b", 0.0, False), ("b", None, True), ("c", 0.0, False)], "k string, cost double, has boolean")
    got = rows.groupBy("k").agg(pricing.known_sum("cost", F.col("has")).alias("skip"), pricing.strict_sum().alias("strict")).collect()
    assert {r["k"]: (r["skip"], r["strict"]) for r in got} == {"a": (1.0, None), "b": (None, None), "c": (0.0, 0.0)}


def test_budget_and_pace(spark):
    months = spark.createDataFrame([("2024-02", 10.0), ("2024-03", 95.0), ("2024-01", None)], "month string, cost double")
    got = {r["month"]: r for r in forecast.monthly_budget(months, 100.0, "2024-02-10").collect()}
    assert got["2024-02"]["projected"] == pytest.approx(29.0) and [got[m]["status"] for m in ("2024-01", "2024-02", "2024-03")] == ["unknown", "on_track", "watch"]
    with pytest.raises(ValueError):
        forecast.monthly_budget(months, 0, "2024-02-10")
    quota = spark.createDataFrame([(60.0, 10080, 604800, 302400), (100.0, 10080, 604800, 604000), (5.0, 10080, 604800, 10**7), (5.0, 10080, 100, 50)], "used_percent double, window_minutes long, resets_at long, observed_at long")
    got = forecast.quota_pace(quota, F.lit(302400).cast("long")).collect()
    assert [(r["status"], r["error"]) for r in got] == [("likely_exhausted", None), (None, "future"), (None, "future"), (None, "expired")]
    assert got[0]["depletes_at"] == 504000


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.percent_decoded(F.lit("%2Fa+b%zz")).alias("bad"), scalars.percent_decoded(F.lit("%2Fa+b")).alias("good"), scalars.work_dir_slug(F.lit("wd_my_app_0123456789ab")).alias("slug"),
        scalars.compact(F.lit(1234567)).alias("compact"), scalars.grouped(F.lit(1234567), "de").alias("grouped"), scalars.money(F.lit(None).cast("double")).alias("money"), scalars.csv_field(F.lit('a"b,c')).alias("csv"),
        scalars.short_id(F.lit("abcdefghijklmnop")).alias("short"), scalars.instant_ms(F.lit("2024-01-01T01:00:00.5+01:00")).alias("ms"), scalars.instant_ms(F.lit("2024-01-01")).alias("none"),
        scalars.day_literal(F.lit("20240131")).cast("string").alias("day"), scalars.local_midnight_ms(F.lit("2024-07-01").cast("date"), "Europe/Berlin").alias("midnight"), scalars.model_name(F.lit("anthropic.claude-x-20240101")).alias("model"),
    ).first()
    assert row.asDict() == {
        "bad": "%2Fa+b%zz", "good": "/a+b", "slug": "my_app", "compact": "1.2M", "grouped": "1.234.567", "money": "N/A", "csv": '"a""b,c"', "short": "abcdefghi...",
        "ms": 1704067200500, "none": None, "day": "2024-01-31", "midnight": 1719784800000, "model": "x",
    }
    assert scalars.did_you_mean("clade", ["codex", "claude"]) == "claude" and scalars.did_you_mean("zzzzzz", ["codex"]) is None


def test_sinks(spark):
    rows = spark.createDataFrame([("d", "a", 1.0, 5), ("d", "b", 3.0, 6), ("d", "c", None, 7)], "date string, model string, cost double, input_tokens long")
    assert sinks.text_table(rows.select("model", "cost"), 2).splitlines()[-1] == "..."


def test_ranges_equal_single_calls(spark, tmp_path, prices):
    import json

    lines = [{"timestamp": f"2024-01-0{d}T10:00:00Z", "message": {"id": f"m{i % 3}", "model": "claude-sonnet-4", "stop_reason": "end" if i % 2 else None, "usage": {"input_tokens": i, "output_tokens": 1}}} for i, d in enumerate((1, 2, 2, 3, 4, 5, 6))]
    (tmp_path / "projects/p").mkdir(parents=True)
    (tmp_path / "projects/p/s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    wanted = {"a": api.Range(date(2024, 1, 1), date(2024, 1, 3)), "b": api.Range(date(2024, 1, 2)), "c": api.Range.this_week(date(2024, 1, 4))}
    many = {r["range_id"]: r.asDict() for r in api.summarize_ranges(spark, "claude", str(tmp_path), prices, wanted).collect()}
    for name, r in wanted.items():
        one = api.summarize(spark, "claude", str(tmp_path), prices, r).first().asDict()
        assert one == {k: v for k, v in many[name].items() if k not in ("range_id", "position")}
    assert api.report(spark, "daily", "cc", str(tmp_path), prices).count() == 3
    with pytest.raises(ValueError):
        api.Range(date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError):
        api.report(spark, "tools", "codex", str(tmp_path), prices)


def test_rates_schema():
    assert len(RATES) == 6 and all(len(row) == 6 for row in pricing.FALLBACK)


def test_zone_names():
    assert scalars.zone_name(" Z ") == scalars.zone_name("utc") == "UTC" and scalars.zone_name("Europe/Berlin") == "Europe/Berlin"
    assert scalars.zone_name(None) == scalars.zone_name("local")
    with pytest.raises(ValueError):
        scalars.zone_name("Mars/Base")
