"""Reports, deduplication and ranges in one pass: the plans they make, and their results against plain Python."""

import io
import json
import random
import re
from contextlib import redirect_stdout
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge import api
from tallyforge.operators import dedup, ordered
from tallyforge.operators.intervals import Cuts
from tallyforge.plans.ledger import price_table
from tallyforge.schema import COLUMNS, USAGE


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def message(at, ident, tokens, stop=None, model="claude-sonnet-4-20250514"):
    return json.dumps({"timestamp": at, "message": {"id": ident, "model": model, "stop_reason": stop, "usage": {"input_tokens": tokens, "output_tokens": 1}}})


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def claude_root(tmp_path_factory):
    """Messages whose repeats lie in several days and files, ids missing, lines that do not parse."""
    r, root = random.Random(21), tmp_path_factory.mktemp("claude")
    for f in range(5):
        lines = []
        for _ in range(60):
            day = r.randint(1, 9)
            at = f"2024-03-0{day}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:00Z"
            model = r.choice(["claude-sonnet-4-20250514", "claude-haiku-4.5", "unheard-of"])
            lines.append(r.choice([message(at, r.choice([None, *(f"m{k}" for k in range(40))]), r.randint(1, 500), r.choice([None, "end"]), model)] * 12 + ["{", message("never", "x", 1)]))
        write(root / f"projects/p{f % 2}/s{f}.jsonl", *lines)
    return str(root)


def test_a_report_reads_its_logs_once(spark, claude_root):
    for kind, exchanges in (("daily", 2), ("statusline", 2), ("session", 2), ("project", 2), ("blocks", 2), ("endpoints", 2)):
        got = api.usage_report(spark, kind, "claude", claude_root, price_table(spark))
        plan = plan_of(got.told)
        assert (plan.count("Scan text"), plan.count("Window"), len(re.findall(r"\bExchange\b", plan))) == (1, 0, exchanges), kind
        made = got.json()
        assert "Scan text" not in plan_of(made) and "Scan text" not in plan_of(got.quality) and made.count() > 0


def test_quality_from_the_same_pass(spark, claude_root):
    scanned = api.loaded(spark, "claude", claude_root)
    rows = [r.asDict() for r in scanned.every.select("message_id", "stop_reason").collect()]
    ids = [r["message_id"] for r in rows if r["message_id"]]
    want = {"valid": len(set(ids)) + sum(not r["message_id"] and r["stop_reason"] is not None for r in rows), "dedup_skipped": len(ids) - len(set(ids))}
    for kind in ("daily", "session", "blocks", "endpoints"):
        got = api.usage_report(spark, kind, "claude", claude_root, price_table(spark)).quality.first().asDict()
        assert {k: got[k] for k in want} == want and got["parse_errors"] == sum(x == "{" or "never" in x for f in range(5) for x in open(f"{claude_root}/projects/p{f % 2}/s{f}.jsonl").read().splitlines())
    assert scanned.quality.first().asDict() == got and scanned.facts.count() == want["valid"]
    none = api.usage_report(spark, "daily", "claude", claude_root, price_table(spark), api.Range(date(1990, 1, 1), date(1990, 1, 2)))
    assert none.quality.first().asDict() == {"valid": 0, "dedup_skipped": 0, "parse_errors": got["parse_errors"]}
    assert [json.loads(r["json"]) for r in none.json().collect()] == [{"data_quality": {"valid_entries": 0, "dedup_skipped_entries": 0, "parse_errors": got["parse_errors"]}}]


def test_counted_rows(spark):
    names = [x.split()[0] for x in USAGE.split(", ")]
    row = lambda **k: tuple({"source": "t", "file_path": "f", "line_ord": 1, "session_key": "s", "timestamp_ms": 1, "stop_reason": "end", "input_tokens": 5, **k}.get(n) for n in names)
    same = row()
    rows = [same, same, row(model="x"), row(stop_reason=None), row(message_id="a", timestamp_ms=None), row(message_id="a", timestamp_ms=-4, input_tokens=9), row(message_id="a", stop_reason=None, timestamp_ms=99), row(message_id="")]
    df = spark.createDataFrame(rows, USAGE).withColumn("rejected", F.lit(False))
    bad = spark.createDataFrame([row(message_id="a", timestamp_ms=500)] * 3, USAGE).withColumn("rejected", F.lit(True))
    best = dedup.counted(df.unionByName(bad).repartition(3))
    got = sorted((str(r["message_id"]), str(r["model"]), r["input_tokens"], r["entries"]) for r in best.where("NOT rejected").collect())
    assert got == [("", "None", 5, 1), ("None", "None", 5, 1), ("None", "None", 5, 1), ("None", "x", 5, 1), ("a", "None", 9, 3)]
    assert dedup.quality_of(best).first().asDict() == {"valid": 5, "dedup_skipped": 2, "parse_errors": 3}
    plan = plan_of(dedup.best_candidate(df))
    assert "Window" not in plan and "partial_min_by" in plan
    assert dedup.counted(df.limit(0)).count() == 0 and dedup.quality_of(dedup.counted(df.limit(0))).first().asDict() == {"valid": 0, "dedup_skipped": 0, "parse_errors": 0}


def summed(rows, since, until):
    """(valid, skipped, input tokens by model) of one range, row by row."""
    inside = [r for r in rows if (since is None and until is None) or (r["date"] is not None and (since is None or r["date"] >= since) and (until is None or r["date"] <= until))]
    best, plain = {}, []
    for r in inside:
        if r["message_id"] is None:
            plain += [r] if r["stop_reason"] is not None else []
            continue
        key = ("" if r["message_id"].startswith("source-wide:") else r["session_key"], r["message_id"])
        order = (r["stop_reason"] is None, -r["timestamp_ms"], r["file_path"], r["line_ord"])
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    won = [r for _, r in best.values()] + plain
    tokens = {}
    for r in won:
        tokens[r["model"]] = tokens.get(r["model"], 0) + r["input_tokens"]
    return len(won), len([r for r in inside if r["message_id"] is not None]) - len(best), tokens


def test_ranges_against_each_by_itself(spark):
    r, start = random.Random(8), date(2024, 1, 1)
    rows = []
    for i in range(900):
        ident = r.choice([None, f"m{r.randint(0, 60)}", f"source-wide:w{r.randint(0, 30)}"])
        rows.append({"message_id": ident, "session_key": f"s{r.randint(0, 2)}", "stop_reason": r.choice([None, None, "end"]), "timestamp_ms": r.randint(0, 400), "file_path": f"f{r.randint(0, 2)}", "line_ord": i, "date": r.choice([None, *(start + timedelta(days=k) for k in range(12))]), "model": f"k{r.randint(0, 2)}", "input_tokens": r.randint(0, 50), "cost_kind": "real", "call_count": 1})
    zero = dict.fromkeys((c for c in COLUMNS if c.endswith("tokens") or c.startswith("cache")), 0)
    df = spark.createDataFrame([tuple((zero | x).get(c) for c in COLUMNS) for x in rows], USAGE).withColumn("rejected", F.lit(False)).repartition(4)
    some = lambda: r.choice([None, start + timedelta(days=r.randint(-3, 15))])
    for many in (6, 60):
        wanted = []
        while len(wanted) < many:
            a, b = some(), some()
            if a is None or b is None or a <= b:
                wanted.append((f"r{len(wanted)}", a, b))
        cuts = Cuts(wanted)
        sums = cuts.sums(df, api.MEASURED)
        assert "NestedLoop" not in plan_of(sums) and "Cartesian" not in plan_of(sums) and "Window" not in plan_of(sums)
        told, quality = cuts.merged(sums.where("NOT rejected"))
        got, counts = {}, {x["range_id"]: (x["valid"], x["dedup_skipped"]) for x in quality.collect()}
        for x in told.collect():
            got.setdefault(x["range_id"], {})[x["model"]] = x["input_tokens"]
        for name, a, b in wanted:
            valid, skipped, tokens = summed(rows, a, b)
            assert (counts[name], got.get(name, {})) == ((valid, skipped), tokens), (name, a, b)
    day = [start + timedelta(days=k) for k in range(40)]
    many = Cuts([(str(k), d, d) for k, d in enumerate(day)])  # more cuts than are compared one by one
    found = spark.createDataFrame([(d,) for d in [None, start - timedelta(days=1), *day, day[-1] + timedelta(days=9)]], "d date").select(many.segment(F.col("d")).alias("s")).collect()
    assert [x["s"] for x in found] == [0, 1, *range(2, 42), 42]
    with pytest.raises(ValueError):
        Cuts([("x", None, None)] * 10_001)


def test_summaries_of_all_sources(spark, claude_root, tmp_path):
    event = {"timestamp": "2024-03-04T00:00:00Z", "model": "gpt-x", "usageEventId": "e1", "tokenUsage": {"inputTokens": 10, "outputTokens": 2}, "chargedCents": 5.0}
    for name in ("usage-1.json", "usage-2.json"):
        write(tmp_path / "cursor" / name, json.dumps({"usageEvents": [event]}))
    roots, prices = {"claude": claude_root, "cursor": f"{tmp_path}/cursor"}, price_table(spark)
    wanted = {"late": api.Range(date(2024, 3, 4)), "none": api.Range(date(2000, 1, 1), date(2000, 1, 1)), "all": api.Range(), "early": api.Range(None, date(2024, 3, 4))}
    many = api.summarize_ranges(spark, "all", roots, prices, wanted).collect()
    assert [r["range_id"] for r in many] == list(wanted) and [r["position"] for r in many] == [0, 1, 2, 3]
    for r in many:
        one = api.summarize(spark, "all", roots, prices, wanted[r["range_id"]]).first().asDict()
        got = {k: v for k, v in r.asDict().items() if k not in ("range_id", "position")}
        assert got.pop("cost") == pytest.approx(one.pop("cost")) and [m["model"] for m in got.pop("models")] == [m["model"] for m in one.pop("models")]
        assert got == one
    none = many[1].asDict()
    assert (none["total_tokens"], none["call_count"], none["cost"], none["models"], none["valid"]) == (0, 0, 0.0, [], 0)
    assert many[2]["valid"] == api.facts(spark, "all", roots).count()  # equal event ids of two documents are two events


def test_unknown_costs_of_rows_and_days(spark, tmp_path):
    known, unknown = "claude-sonnet-4-20250514", "unheard-of"
    write(tmp_path / "projects/p/s.jsonl", message("2024-01-01T00:00:00Z", "a", 10, "end", known), message("2024-01-01T00:00:00Z", "b", 10, "end", unknown))
    costs = lambda root, **k: [json.loads(r["json"])["cost"] for r in api.usage_report(spark, "daily", "claude", root, price_table(spark), strict=True).json(**k).collect()]
    line = lambda root: json.loads(api.usage_report(spark, "statusline", "claude", root, price_table(spark), strict=True).json().first()["json"])
    assert costs(str(tmp_path))[0] > 0 and costs(str(tmp_path), breakdown=True) == [None]
    assert line(str(tmp_path))["cost"] > 0
    write(tmp_path / "projects/p/t.jsonl", message("2024-01-02T00:00:00Z", "c", 10, "end", unknown))
    assert line(str(tmp_path))["cost"] is None and line(str(tmp_path))["formatted"]["cost"] == "N/A"
    empty = line(f"{tmp_path}/nowhere")
    assert (empty["cost"], empty["total_tokens"], empty["input_tokens"]) == (0.0, 0, 0)


def test_small_and_large_orders_agree(spark):
    rows = spark.range(500).select(F.pmod(F.hash("id"), F.lit(7)).alias("k"), "id")
    order = [F.col("k").desc(), F.col("id").asc()]
    few, many = ({(r["id"], r["place"]) for r in ordered.numbered(rows, order, few).collect()} for few in (True, False))
    assert few == many


def test_counts_stop_at_the_largest_long(spark, tmp_path):
    most = 2**63 - 1
    write(tmp_path / "projects/p/s.jsonl", *[message(f"2024-01-0{d}T00:00:00Z", f"m{d}", most, "end") for d in (1, 2)])
    for kind in ("daily", "monthly", "session", "blocks"):
        rows = [json.loads(r["json"]) for r in api.usage_report(spark, kind, "claude", str(tmp_path), price_table(spark)).json().collect()]
        assert all(r["input_tokens"] == r["total_tokens"] == most for r in rows)
    assert api.summarize(spark, "claude", str(tmp_path), price_table(spark), api.Range()).first()["total_tokens"] == most
