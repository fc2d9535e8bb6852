"""Small logs of every format with hand-derived facts."""

import json
import os
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyforge import api
from tallyforge.operators import files, sinks
from tallyforge.operators.dedup import best_candidate, counted, quality_of
from tallyforge.plans.ledger import price_table
from tallyforge.plans.pricing import Currency
from tallyforge.schema import PRICE
from tallyforge.sources import SOURCES, claude, codex, grok, tails
from tallyforge.sources.base import combined, json_lines
from tallyforge.sources.dimensions import CatalogueError, exchange_rates, load_prices, settings


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def message(ts, id_, inp, out, stop=None, model="claude-sonnet-4", **more):
    return {"timestamp": ts, "message": {"id": id_, "model": model, "stop_reason": stop, "usage": {"input_tokens": inp, "output_tokens": out, **more}}}


def test_streamed_messages(spark, tmp_path):
    """A message grows in three steps over two files and ends in the second; another is never finished; a third has no id."""
    write(
        tmp_path / "projects/alpha/day.jsonl",
        message("2025-03-09T07:00:00.250Z", "grow", 4, 1),
        message("2025-03-09T07:00:02Z", "grow", 4, 9, inference_geo="us"),
        message("2025-03-09T07:05:00Z", "open", 31, 2, inference_geo="not_available"),
        message("2025-03-09T07:06:00Z", None, 6, 6, "stop"),
        message("2025-03-09T07:07:00Z", None, 8, 8),
        message("2025-03-09T07:08:00Z", "zero", -3, -4, "stop", cache_creation_input_tokens=12, cache_creation={"ephemeral_1h_input_tokens": 40}, inference_geo="", model="anthropic.claude-opus-9-20300102"),
        message("2025-03-09T07:09:00Z", "made up", 1, 1, "stop", model="<synthetic>"),
        message("2025-03-09T07:10:00Z", "made up", 1, 1, "stop", model=" "),
        "   ",
        '{"timestamp": "2025-03-09T07:11:00Z", "message": {"usage": {"output_tokens": 1.5}}}',
        '{"timestamp": "2025-03-09T07:12',
        message("09.03.2025", "when", 1, 1),
        {"type": "note", "message": {"id": "n"}},
    )
    write(tmp_path / "projects/beta/deep/er/night.jsonl", message("2025-03-09T06:00:00Z", "grow", 4, 77, "stop"))
    facts, errors = claude.SOURCE.facts(spark, str(tmp_path))
    assert errors.first()["parse_errors"] == 3
    best = best_candidate(facts)
    got = {r["message_id"]: r for r in best.collect()}
    assert set(got) == {"source-wide:claude:grow", "source-wide:claude:open", "source-wide:claude:zero", None}
    grown, zero = got["source-wide:claude:grow"], got["source-wide:claude:zero"]
    assert (grown["output_tokens"], grown["session_id"], grown["project_path"], grown["endpoint"], grown["model"]) == (77, "night", "beta", "unknown", "sonnet-4")
    assert (zero["input_tokens"], zero["output_tokens"], zero["cache_creation"], zero["cache_creation_1h"], zero["endpoint"], zero["model"]) == (0, 0, 12, 12, "proxy", "opus-9")
    assert (got[None]["input_tokens"], got["source-wide:claude:open"]["endpoint"]) == (6, "native")
    assert quality_of(counted(facts)).first().asDict() == {"valid": 4, "dedup_skipped": 2, "parse_errors": 0}
    assert quality_of(counted(claude.scan(spark, str(tmp_path)))).first().asDict() == {"valid": 4, "dedup_skipped": 2, "parse_errors": 3}


def test_absent_roots_are_empty(spark, tmp_path):
    for name in ("claude", "codex", "cursor", "grok", "kimi"):
        facts, errors = SOURCES.find(name).facts(spark, f"{tmp_path}/nowhere")
        assert facts.count() == 0 and errors.first()["parse_errors"] == 0
    assert codex.quota_snapshot(spark, f"{tmp_path}/nowhere", 10**9).first()["error"] == "sessions_not_found"


def test_lines_keep_their_order_across_splits(spark, tmp_path):
    write(tmp_path / "sessions/long.jsonl", *[{"type": "turn_context", "n": i, "pad": "x" * (i % 50)} for i in range(4000)])
    write(tmp_path / "sessions/short.jsonl", {"n": 0})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        rows = json_lines(spark, f"{tmp_path}/sessions", "n bigint")
        parts = rows.where("file_path LIKE '%long%'").select("line_ord", "j.n", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["p"] for r in parts}) > 3
    ordered = sorted(parts, key=lambda r: r["line_ord"])
    assert [r["n"] for r in ordered] == list(range(4000)) and len({r["line_ord"] for r in parts}) == 4000


def test_tool_calls(spark, tmp_path):
    use = lambda i: {"type": "tool_use", "name": "Read", "id": i}
    write(
        tmp_path / "projects/p/s.jsonl",
        {"timestamp": "2026-01-01T10:00:00Z", "message": {"id": "m", "content": [use("a"), {"type": "text"}]}},
        {"timestamp": "2026-01-01T10:00:01Z", "message": {"id": "m", "content": [use("a")]}},
        {"data": {"message": {"timestamp": "2026-01-02T00:00:00Z", "message": {"id": "q", "content": [use("b")]}}}},
        {"message": {"content": 'a plain "tool_use" text'}},
    )
    rows = claude.tool_calls(spark, str(tmp_path)).collect()
    assert sorted((r["name"], str(r["date"]), r["message_id"], r["tool_use_id"]) for r in rows) == [
        ("Read", "2026-01-01", "m", "a"), ("Read", "2026-01-01", "m", "a"), ("Read", "2026-01-02", "q", "b"),
    ]


def counter(ts, total, last=None, model=None):
    v = lambda t: dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), t))
    info = {"total_token_usage": v(total), **({"last_token_usage": v(last)} if last else {}), **({"model": model} if model else {})}
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_cumulative_counters(spark, tmp_path):
    write(
        tmp_path / "sessions/2026/a.jsonl",
        {"type": "session_meta", "payload": {"id": "S", "source": "cli"}},
        counter("2025-06-01T09:00:00Z", (64, 16, 24, 8, 88)),
        counter("2025-06-01T09:00:07Z", (64, 16, 24, 8, 88), model="ignored"),
        {"type": "turn_context", "payload": {"model": "gpt-5.4"}},
        counter("2025-06-01T09:01:00Z", (97, 16, 24, 8, 121)),
        counter("no time", (99, 16, 24, 8, 123)),
        {"type": "session_meta", "payload": {"source": {"exec": {}}}},
        counter("2025-06-01T09:02:00Z", (150, 16, 24, 8, 174), last=(11, 3, 6, 2, 17), model="m2"),
    )
    rows = codex.scan(spark, str(tmp_path)).orderBy("line_ord").collect()
    good = [(r["model"], r["input_tokens"], r["cache_read"], r["output_tokens"], r["reasoning_tokens"]) for r in rows if not r["rejected"]]
    assert good == [("gpt-5", 48, 16, 16, 8), ("gpt-5.4", 33, 0, 0, 0), ("m2", 8, 3, 4, 2)]
    assert sum(r["rejected"] for r in rows) == 1
    assert {r["session_key"] for r in rows} == {"codex-session:S"}
    only = codex.scan(spark, str(tmp_path), scope="exec").where("NOT rejected").collect()
    assert [r["input_tokens"] for r in only] == [8]
    with pytest.raises(ValueError):
        codex.scan(spark, str(tmp_path), scope="some")


def test_replays_of_one_session_count_once(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"sessions/{name}.jsonl", {"type": "session_meta", "payload": {"id": "S"}}, counter("2025-06-02T00:00:00Z", (42, 0, 9, 0, 51)))
    write(tmp_path / "sessions/c.jsonl", {"type": "session_meta", "payload": {"id": "T"}}, counter("2025-06-02T00:00:00Z", (42, 0, 9, 0, 51)))
    facts, _ = codex.SOURCE.facts(spark, str(tmp_path))
    assert best_candidate(facts).count() == 2


def limits(ts, used, week=10080):
    spans = {"primary": {"used_percent": 70.5, "window_minutes": 60, "resets_at": 7}, "secondary": {"used_percent": used, "window_minutes": week, "resets_at": 1_760_400_000}}
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "rate_limits": spans}}


def test_quota_snapshot(spark, tmp_path):
    now = 1_760_000_000  # 2025-10-09
    folder = tmp_path / "sessions/2025/10/08"
    write(folder / "x.jsonl", limits("2025-10-08T01:00:00Z", 33.0), limits("2025-10-08T03:00:00Z", 12.5), limits("2025-10-08T05:00:00Z", 99.0, week=1))
    (folder / "y.jsonl").write_text(json.dumps(limits("2025-10-08T02:00:00Z", 44.0)) + '\n{"timestamp": "2025-10-08T04:0')  # still being written
    got = codex.quota_snapshot(spark, str(tmp_path), now).first()
    assert (got["used_percent"], got["window_minutes"], got["resets_at"], got["error"]) == (12.5, 10080, 1_760_400_000, None)
    old = tmp_path / "sessions/2025/09/01/z.jsonl"
    write(old, limits("2025-10-08T23:00:00Z", 1.0))
    assert codex.quota_snapshot(spark, str(tmp_path), now).first()["used_percent"] == 1.0  # changed just now
    os.utime(old, (now - 20 * 86_400,) * 2)
    assert codex.quota_snapshot(spark, str(tmp_path), now).first()["used_percent"] == 12.5
    write(folder / "w.jsonl", "{broken", limits("2025-10-08T01:00:00Z", 5.0), "{broken", {"type": "note"})
    assert codex.quota_snapshot(spark, str(tmp_path), now).first()["error"] == "malformed_line"
    with pytest.raises(api.QuotaError, match="malformed_line"):
        api.weekly_value(spark, str(tmp_path), spark.createDataFrame([], PRICE), now)


@pytest.mark.parametrize("used, error", [(101.0, "invalid_percent"), (None, "snapshot_not_found")])
def test_quota_errors(spark, tmp_path, used, error):
    write(tmp_path / "sessions/a.jsonl", limits("2025-10-08T01:00:00Z", used) if used else {"type": "rate_limits"})
    assert codex.quota_snapshot(spark, str(tmp_path)).first()["error"] == error


def test_billing_events(spark, tmp_path):
    use = {"inputTokens": 61, "outputTokens": 17.8, "cacheWriteTokens": 5, "cacheReadTokens": 2}
    write(
        tmp_path / "usage.json",
        {
            "events": [
                {"timestamp": "2026-01-01T00:00:00Z", "model": "m", "conversationId": "c", "usageEventId": "1", "tokenUsage": use, "chargedCents": 3.2},
                {"timestamp": "1767225600000", "usageEventId": "1", "tokenUsage": use},
                {"timestamp": 1767225600000, "inputTokens": 7},
                {"timestamp": "2026-01-01T00:00:00Z", "tokenUsage": {}},
                {"inputTokens": 5},
            ]
        },
    )
    rows = SOURCES.find("CUR").scan(spark, str(tmp_path)).orderBy("line_ord").collect()
    assert [(r["message_id"], r["model"], r["input_tokens"], r["output_tokens"], r["cache_read"], r["recorded_cost_usd"]) for r in rows] == [
        ("event:1", "m", 61, 17, 2, 0.032), ("event:2", "cursor", 7, 0, 0, None),
    ]
    assert rows[1]["timestamp_ms"] == 1767225600000


def test_inference_log(spark, tmp_path):
    write(
        tmp_path / "logs/unified.jsonl",
        {"ts": "2026-01-01T00:00:00Z", "sid": "s", "msg": grok.DONE, "ctx": {"loop_index": 1, "prompt_tokens": 260000, "cached_prompt_tokens": 90000, "completion_tokens": 14, "reasoning_tokens": 50}},
        {"ts": "2026-01-01T00:00:00Z", "sid": "", "msg": grok.DONE, "ctx": {"prompt_tokens": 1}},
        {"ts": "2026-01-01T00:00:00Z", "sid": "s", "msg": "other"},
    )
    write(tmp_path / "sessions/%2Fhome%2Fme/s/summary.json", {"current_model_id": "grok-4.5", "updated_at": "2026-01-01T00:00:00Z"})
    (row,) = grok.unified(spark, str(tmp_path)).collect()
    assert (row["model"], row["project_path"], row["input_tokens"], row["cache_read"], row["output_tokens"], row["reasoning_tokens"]) == ("grok-4.5", "/home/me", 170000, 90000, 0, 14)
    assert row["recorded_cost_usd"] == pytest.approx(170000 * 4e-6 + 90000 * 0.6e-6 + 14 * 12e-6)


def test_turns_leave_a_rest_and_sessions_without_turns_are_estimated(spark, tmp_path):
    usage = {"inputTokens": 90, "outputTokens": 21, "modelCalls": 5, "costUsdTicks": 3 * 10**10, "modelUsage": {"a": {"inputTokens": 52, "outputTokens": 21, "modelCalls": 2}}}
    write(
        tmp_path / "sessions/p/s1/updates.jsonl",
        {"timestamp": 1767225600, "params": {"sessionId": "s1", "update": {"sessionUpdate": "turn_completed", "prompt_id": "q", "usage": usage}}},
        {"timestamp": 1767225600, "params": {"update": {"sessionUpdate": "turn_completed"}}},
    )
    write(tmp_path / "sessions/p/s1/summary.json", {"updated_at": "2026-01-01T00:00:00Z"})
    write(tmp_path / "sessions/p/s2/summary.json", {"updated_at": "2026-01-01T00:00:00Z"})
    write(tmp_path / "sessions/p/s2/signals.json", {"contextTokensUsed": 881, "totalTokensBeforeCompaction": 46, "primaryModelId": "z"})
    write(tmp_path / "sessions/p/s3/summary.json", {"updated_at": "2026-01-01T00:00:00Z"})
    write(tmp_path / "sessions/p/s3/updates.jsonl", *[{"params": {"_meta": {"totalTokens": n}}} for n in (75, 310, 290)])
    rows = grok.scan(spark, str(tmp_path), files="sessions").collect()
    got = {(r["session_id"], r["model"]): r for r in rows if not r["rejected"]}
    assert sum(r["rejected"] for r in rows) == 1
    assert (got["s1", "a"]["input_tokens"], got["s1", "a"]["recorded_cost_usd"]) == (52, 0.0)
    assert (got["s1", "grok"]["input_tokens"], got["s1", "grok"]["call_count"], got["s1", "grok"]["recorded_cost_usd"]) == (38, 3, 3.0)
    assert (got["s2", "z"]["input_tokens"], got["s2", "z"]["cost_kind"]) == (927, "estimated_proxy")
    assert got["s3", "grok"]["input_tokens"] == 310


def test_wire_log(spark, tmp_path):
    use = lambda t, *n, **k: {"type": "usage.record", "usageScope": "turn", "model": "k2", "time": t, "usage": dict(zip(("inputOther", "output", "inputCacheRead", "inputCacheCreation"), n)), **k}
    write(tmp_path / "sessions/wd_web_0123456789ab/S/agents/main/wire.jsonl", use(1740000000000, 31, 12, 5, 9), use(1740000000500, 64, 3, 0, 0), use(0, 1), use(1740000000900, 0, 0, 0, 0))
    write(tmp_path / "sessions/wd_web_0123456789ab/S/agents/sub/wire.jsonl", use(1740000001000, 2, 11), use(1740000001000, 2, 11, usageScope="session"))
    facts, errors = SOURCES.find("kimi").facts(spark, str(tmp_path))
    total = facts.agg(*[F.sum(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation")]).first()
    assert tuple(total) == (97, 26, 5, 9) and errors.first()[0] == 1
    assert facts.select("session_key", "project_path").distinct().count() == 1 and facts.first()["project_path"] == "web"
    write(tmp_path / "session_index.jsonl", {"sessionId": "S", "workDir": "/old"}, {"sessionId": "S", "workDir": "/new"})
    assert SOURCES.find("km").facts(spark, str(tmp_path))[0].first()["project_path"] == "/new"


def test_lookup():
    assert SOURCES.find(" CC ").name == "claude"
    with pytest.raises(KeyError, match="codex"):
        SOURCES.find("codez")
    both = combined([SOURCES["claude"], SOURCES["codex"]])
    assert both.tools and both.quota and both.cache_read and not combined([]).cache_read


def sessions_by_hand(root, scope, default="gpt-5"):
    """Accepted growth of counter logs, line by line."""
    out = []
    for path in sorted(root.rglob("*.jsonl")):
        model, said, ident, before = default, None, None, None
        for line in path.read_text().splitlines():
            x = json.loads(line)
            p = x.get("payload", {})
            if x["type"] == "session_meta":
                said = {"cli": "interactive", "exec": "exec"}.get(p.get("source"))
                ident = p.get("id") or ident
            elif x["type"] == "turn_context":
                model = p.get("model") or model
            elif p.get("type") == "token_count" and (scope == "all" or said == scope):
                t = p["info"]["total_token_usage"]
                now = tuple(t.values())
                grown = [max(a - b, 0) for a, b in zip(now, before or (0,) * 5)]
                if now != before and sum(grown[:4]):
                    model = p["info"].get("model") or model
                    out.append((ident and f"codex-session:{ident}", x["timestamp"], model, max(grown[0] - grown[1], 0), min(grown[1], grown[0])))
                before = now
    return sorted(out, key=str)


def test_long_files_are_read_in_parts(spark, tmp_path):
    """State is carried over the splits of a file: heads, models and totals many splits back."""
    r = random.Random(4)
    for name in ("a", "b"):
        lines, total = [{"type": "session_meta", "payload": {"id": f"S{name}", "source": "cli"}}], [0] * 5
        for i in range(1500):
            kind = r.random()
            if kind < 0.004:
                lines.append({"type": "session_meta", "payload": {"id": r.choice(["", f"S{name}{i}"]), "source": r.choice(["cli", "exec", "other"])}})
            elif kind < 0.01:
                lines.append({"type": "turn_context", "payload": {"model": f"m{i}"}})
            elif kind < 0.5:
                lines.append({"type": "event_msg", "payload": {"type": "note", "text": "x" * r.randint(1, 400)}})
            else:
                total = [t + r.choice([0, 0, 3, 9]) for t in total] if r.random() < 0.98 else [0] * 5
                lines.append(counter(f"2025-06-01T{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}Z", total, model=f"own{i}" if r.random() < 0.02 else None))
        write(tmp_path / f"sessions/{name}.jsonl", *lines)
    show = lambda rows: sorted(((x["session_key"] if x["session_key"].startswith("codex") else None, x["timestamp"], x["model"], x["input_tokens"], x["cache_read"]) for x in rows.collect()), key=str)
    keys = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    for scope in ("all", "interactive", "exec"):
        want = sessions_by_hand(tmp_path, scope)
        assert not codex.splits_files(spark, f"{tmp_path}/sessions") and show(codex.scan(spark, str(tmp_path), scope=scope)) == want
        for k, v in keys.items():
            spark.conf.set(k, v)
        try:
            assert codex.splits_files(spark, f"{tmp_path}/sessions")
            parts = codex.scan(spark, str(tmp_path), scope=scope)
            assert show(parts) == want and len(want) > 100
        finally:
            for k in keys:
                spark.conf.unset(k)


def test_quota_is_read_from_the_end(spark, tmp_path):
    """However long a file is, about as much of it is read as lies behind its last limit."""
    folder, noise = tmp_path / "sessions/2025/10/08", {"type": "event_msg", "payload": {"type": "note", "text": "x" * 1000}}
    write(folder / "far.jsonl", limits("2025-10-08T01:00:00Z", 33.0), *[noise] * 3000, limits("2025-10-08T03:00:00Z", 12.5), *[noise] * 100)
    write(folder / "none.jsonl", *[noise] * 300)
    files = codex.session_files(spark, f"{tmp_path}/sessions")
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in tails.last_limits(files, codex.WEEK_MINUTES).collect()}
    assert got["far.jsonl"]["used_percent"] == 12.5 and got["far.jsonl"]["bytes_read"] <= 100 * 1100 + 2 * tails.CHUNK < (folder / "far.jsonl").stat().st_size // 10
    assert got["none.jsonl"]["bytes_read"] == (folder / "none.jsonl").stat().st_size and got["none.jsonl"]["ms"] is None
    assert codex.quota_snapshot(spark, str(tmp_path)).first()["used_percent"] == 12.5


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_lines_from_the_end(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(tails, "CHUNK", chunk)
    for text in (b"", b"\n", b"a", b"a\n", b"\n\na\nbb\n\nccc", b"x" * 100 + b"\n" + b"y" * 30 + b"\n"):
        path = tmp_path / "f"
        path.write_bytes(text)
        with path.open("rb") as f:
            got = list(tails.lines_from_end(f, len(text)))
        assert [x for x, _, _ in got if x] == [x for x in reversed(text.split(b"\n")) if x]
        assert [end for x, end, _ in got if x] == [i == 0 and not text.endswith(b"\n") for i in range(len([x for x in text.split(b"\n") if x]))]


def test_half_written_and_malformed_limits(spark, tmp_path):
    path = tmp_path / "sessions/a.jsonl"
    good = json.dumps(limits("2025-10-08T01:00:00Z", 5.0))
    snapshot = lambda: codex.quota_snapshot(spark, str(tmp_path)).first()
    path.parent.mkdir()
    for cut in ('{"a', '{"a":tr', '{"a":1', '{"a":"\\u00', '{"a":"é'.encode()[:-1], "{"):
        path.write_bytes(good.encode() + b"\n" + (cut if isinstance(cut, bytes) else cut.encode()))
        assert (snapshot()["error"], snapshot()["used_percent"]) == (None, 5.0), cut
        path.write_bytes(good.encode() + b"\n" + (cut if isinstance(cut, bytes) else cut.encode()) + b"\n")
        assert snapshot()["error"] == "malformed_line", cut
    bad = ['{"a" 1}', '{"type": 5}', "[]", good.replace("10080", '"week"'), good.replace("5.0", "null"), good.replace("01:00:00Z", "25:00:00Z"), good.replace('"2025-10-08T01:00:00Z"', "null")]
    for line in bad:
        path.write_text(good + "\n" + line)
        assert snapshot()["error"] == "malformed_line", line
        path.write_text(line + "\n" + good)
        assert snapshot()["error"] is None, line
    (tmp_path / "link").mkdir()
    (tmp_path / "link/sessions").symlink_to(tmp_path / "sessions")
    assert codex.quota_snapshot(spark, f"{tmp_path}/link").first()["error"] == "sessions_is_a_link"
    with pytest.raises(api.QuotaError, match="sessions_is_a_link"):
        api.weekly_value(spark, f"{tmp_path}/link", spark.createDataFrame([], PRICE), 10**9)


def price_file(path, model="claude-sonnet-4", cost=1e-6, text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({model: {"input_cost_per_token": cost, "output_cost_per_token": 2 * cost}}) if text is None else text)
    return str(path)


def test_states_of_the_price_cache(spark, tmp_path):
    """No file, a fresh one, a stale one and a malformed one; offline, and with a fetch that works or does not."""
    now = 1_760_000_000
    one, two, new = tmp_path / "a/prices.json", tmp_path / "b/prices.json", price_file(tmp_path / "new.json", cost=7e-6)
    paths = [str(one), str(two)]
    load = lambda **k: load_prices(spark, paths, now, **k)
    rate = lambda p: {r["price_key"]: r["input"] for r in p.table.collect()}.get("claude-sonnet-4")
    for options in ({}, {"offline": False}, {"offline": False, "fetch": lambda: None}):
        none = load(**options)
        assert (none.source, none.age_s, none.table.count()) == ("fallback", None, 0)
    price_file(two, cost=3e-6)
    os.utime(two, (now - 3600,) * 2)
    fresh = load(offline=False, fetch=lambda: 1 / 0)  # nothing is fetched
    assert (fresh.source, fresh.age_s, fresh.mtime_s, rate(fresh)) == ("cache", 3600, now - 3600, 3e-6)
    os.utime(two, (now - 100_000,) * 2)
    for options in ({}, {"offline": False, "fetch": lambda: None}):
        stale = load(**options)
        assert (stale.source, stale.age_s, rate(stale)) == ("cache_stale", 100_000, 3e-6)
    price_file(one, text="{not json")
    with pytest.raises(CatalogueError, match="malformed"):
        load()  # the second file does not stand in
    with pytest.warns(UserWarning, match="fetched anew"), pytest.raises(CatalogueError):
        load(offline=False, fetch=lambda: None)
    with pytest.warns(UserWarning, match="fetched anew"):
        live = load(offline=False, fetch=lambda: new)
    assert (live.source, live.age_s, rate(live)) == ("live", None, 7e-6) and json.loads(one.read_text()) == json.loads(open(new).read())
    assert load().source == "cache_stale" and rate(load()) == 7e-6  # saved; by its clock it is of the future


def test_prices_of_a_cache_tell_its_age(spark, tmp_path):
    write(tmp_path / "projects/p/s.jsonl", message("2026-01-01T00:00:00Z", "a", 1000, 0, "end"), message("2026-01-02T00:00:00Z", "b", 10, 0, "end", model="haiku"))
    path = price_file(tmp_path / "prices.json")
    os.utime(path, (1_760_000_000 - 50,) * 2)
    got = api.usage_report(spark, "daily", "claude", str(tmp_path), load_prices(spark, [path], 1_760_000_000))
    first, second = (json.loads(r["json"]) for r in got.json().orderBy("place").collect())
    assert (first["pricing_source"], first["pricing_cache_age_seconds"], first["pricing_cache_mtime_epoch_seconds"]) == ("cache", 50, 1_759_999_950)
    assert second["pricing_source"] == "fallback" and "pricing_cache_age_seconds" not in second
    lines = [r["line"] for r in got.csv().orderBy("part", "place").collect()]
    assert lines[0].endswith(",pricing_source,pricing_cache_age_seconds,pricing_cache_mtime_epoch_seconds") and lines[1].endswith(",cache,50,1759999950") and lines[2].endswith(",fallback,,")


def test_reports_as_files(spark, tmp_path):
    """Bytes of whole files; what a killed attempt left behind does not matter."""
    write(tmp_path / "projects/p/s.jsonl", message("2026-01-02T00:00:00Z", "a", 3, 1, "end", model="other"), message("2026-01-01T00:00:00Z", "b", 5, 0, "end", model="odd, name"), "{")
    got = api.usage_report(spark, "daily", "claude", str(tmp_path), price_table(spark), strict=True)
    out = tmp_path / "out/report"
    out.parent.mkdir()
    (tmp_path / "out/report.0.tmp").write_text("half a re")
    out.write_text("old")
    got.save(str(out), "csv")
    assert out.read_text() == (
        "date,input_tokens,output_tokens,reasoning_tokens,cache_creation_tokens,cache_read_tokens,cache_hit_rate,total_tokens,cost,pricing_source\n"
        '2026-01-01,5,0,0,0,0,0.00,5,N/A,unknown\n2026-01-02,3,1,0,0,0,0.00,4,N/A,unknown\n# data_quality valid=2 dedup_skipped=0 parse_errors=1\n'
    )
    got.save(str(out), "json", descending=True)
    rows = json.loads(out.read_text())
    assert [r["date"] for r in rows] == ["2026-01-02", "2026-01-01"] and out.read_text().count("\n") == 4 and rows[0]["data_quality"]["parse_errors"] == 1
    got.save(str(out), "table", breakdown=True)
    lines = out.read_text().splitlines()
    assert lines[0].split() == ["date", "model", "input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning_tokens", "call_count", "total_tokens", "hit_rate", "cost"]
    assert [x.split()[0] for x in lines[2:]] == ["2026-01-01", "2026-01-01", "2026-01-02", "2026-01-02", "TOTAL", "1"] and "odd, name" in lines[3]
    with pytest.raises(ValueError, match="format"):
        got.save(str(out), "xml")
    assert sorted(p.name for p in out.parent.iterdir()) == ["report", "report.0.tmp"]


def test_large_reports_as_files(spark, tmp_path):
    rows = spark.range(5000).select(F.lit(1).alias("part"), (5000 - F.col("id")).alias("place"), F.concat(F.lit("line "), 5000 - F.col("id")).alias("line")).repartition(7)
    files.saved(rows, f"{tmp_path}/deep/er/lines.txt")
    assert (tmp_path / "deep/er/lines.txt").read_text().splitlines() == [f"line {i}" for i in range(1, 5001)]
    files.saved(rows.limit(0), f"{tmp_path}/none.txt")
    assert (tmp_path / "none.txt").read_text() == ""


def test_tables_and_currency(spark, tmp_path):
    write(tmp_path / "projects/p/s.jsonl", message("2026-01-02T00:00:00Z", "a", 10**6, 0, "end", model="claude-sonnet-4-20250514"), message("2026-01-02T06:00:00Z", "b", 10**6, 0, "end", model="claude-haiku-4.5"))
    euro = Currency.of(" eur ", {"EUR": 0.5})
    report = lambda kind, **k: api.usage_report(spark, kind, "claude", str(tmp_path), price_table(spark), strict=True, **k)
    assert json.loads(report("daily", currency=euro).json().first()["json"])["cost"] == pytest.approx(2.0)
    assert report("statusline", currency=euro).table() == "Claude Code: €2.00 | In: 2.0M Out: 0 | Cache Hit: 0.0%"
    for kind, first in (("daily", "2026-01-02"), ("session", "s"), ("project", "p"), ("blocks", "2026-01-02"), ("endpoints", "unknown"), ("models", "haiku-4.5")):
        lines = report(kind).table().splitlines()
        assert len(lines) >= 4 and any(first in x for x in lines[2:]) and "TOTAL" in lines[-1] and lines[-1].endswith("$4.00"), kind
    top = sinks.text_table(sinks.top_table(api.top(spark, "model", "claude", str(tmp_path), price_table(spark), strict=True), "model")).splitlines()
    assert top[2].split() == ["1", "sonnet-4", "1", "1,000,000", "$3.00", "75.00%"]
    months = api.budget(spark, "claude", str(tmp_path), price_table(spark), 5.0, date(2026, 1, 31), strict=True)
    assert sinks.text_table(sinks.budget_table(months)).splitlines()[2].split() == ["2026-01", "$4.00", "$5.00", "$4.00", "$1.00", "80.0%", "80.0%", "on_track"]
    assert json.loads(sinks.budget_json(months).first()["json"])["budget"]["status"] == "on_track"
    counts = spark.createDataFrame([("Read", 3, 75.0), ("Edit", 1, 25.0)], "name string, calls long, share double")
    assert [x.split() for x in sinks.text_table(sinks.tools_table(counts)).splitlines()[2:]] == [["Read", "3", "75.0%"], ["Edit", "1", "25.0%"], ["TOTAL", "4", "100.0%"]]
    with pytest.raises(ValueError, match="exchange rate"):
        Currency.of("XXX", {"EUR": 1.0})
    rates = tmp_path / "rates.json"
    rates.write_text('{"rates": {"eur": 0.5}}')
    assert Currency.of("EUR", exchange_rates(str(rates))) == euro
    (tmp_path / "c.toml").write_text('zone = "UTC"\nstrict = true')
    assert settings([f"{tmp_path}/none.toml", f"{tmp_path}/c.toml"], zone="Asia/Tokyo", currency=None) == {"zone": "Asia/Tokyo", "strict": True}


def test_quota_report_with_its_value(spark, tmp_path):
    now, reset = 1_760_000_000, 1_760_400_000
    line = limits("2025-10-09T08:00:00Z", 20.0)
    line["payload"]["info"] = {"total_token_usage": {"input_tokens": 10**6, "output_tokens": 0, "total_tokens": 10**6}, "model": "gpt-5"}
    write(tmp_path / "sessions/2025/10/09/a.jsonl", line)
    got = api.quota_report(spark, str(tmp_path), now, price_table(spark), strict=True)
    told = json.loads(sinks.quota_json(got).first()["json"])
    assert (told["used_pct"], told["estimated_window_value_usd"], told["value_error"]) == (20.0, 6.25, None) and reset > now
    lines = [r["line"] for r in sinks.quota_csv(got).orderBy("part", "place").collect()]
    assert lines[0].endswith("estimated_depletion_at,estimated_window_value_usd,value_error") and ",20.00,80.00," in lines[1] and lines[1].endswith(",6.25,")
    assert "used_pct" in sinks.text_table(sinks.quota_table(api.quota_report(spark, str(tmp_path), now)))
    with pytest.raises(ValueError, match="USD"):
        api.quota_report(spark, str(tmp_path), now, currency="EUR")
    with pytest.raises(api.QuotaError, match="expired"):
        api.quota_report(spark, str(tmp_path), reset + 1)


def test_only_the_pages_of_the_wanted_days_are_read(spark, tmp_path):
    """Pages of other days are broken: they are an error if they are read."""
    at = lambda day, hour=0: int(datetime(2026, 1, day, hour, tzinfo=timezone.utc).timestamp() * 1000)
    event = lambda day, ident, hour=0: {"timestamp": at(day, hour), "model": "m", "usageEventId": ident, "tokenUsage": {"inputTokens": day}}
    index = []
    for n, day in enumerate((9, 8, 7, 6), 1):
        found = [event(day, f"x{day}", 20), event(day, "twice"), event(day, f"y{day}")]
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"usageEventsDisplay": found}) if day in (7, 8) else "{broken")
        index.append({"page": n, "file": f"page-{n}.json", "first_ms": at(day), "last_ms": at(day, 20), "has_next": n < 4})
    write(tmp_path / "index.jsonl", *index)
    facts = lambda since, until, zone="UTC": sorted((r["message_id"], r["input_tokens"]) for r in api.facts(spark, "cursor", str(tmp_path), zone, api.Range(since, until)).collect())
    assert facts(date(2026, 1, 7), date(2026, 1, 8)) == [("event:twice", 8), ("event:x7", 7), ("event:x8", 8), ("event:y7", 7), ("event:y8", 8)]
    assert facts(date(2026, 1, 8), date(2026, 1, 8), "Asia/Tokyo") == [("event:twice", 8), ("event:x7", 7), ("event:y8", 8)]  # 20:00 UTC is the next day there
    assert facts(date(2020, 1, 1), date(2020, 1, 1)) == []
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        facts(date(2026, 1, 7), None)
    write(tmp_path / "index.jsonl", *index[:3])
    with pytest.raises(Exception, match="partial"):
        facts(date(2026, 1, 7), date(2026, 1, 8))
    write(tmp_path / "index.jsonl", *index[1:])
    with pytest.raises(Exception, match="partial"):
        facts(date(2026, 1, 7), date(2026, 1, 8))


def test_the_choice_of_files(spark, tmp_path):
    """The log, what a ledger kept of it, or the sessions, in this order."""
    write(tmp_path / "sessions/p/s1/summary.json", {"updated_at": "2026-01-01T00:00:00Z"})
    write(tmp_path / "sessions/p/s1/signals.json", {"contextTokensUsed": 881})
    log, kept = tmp_path / "logs/unified.jsonl", f"{tmp_path}/kept"
    tokens = lambda **k: sorted(r["input_tokens"] for r in api.facts(spark, "grok", str(tmp_path), **k).collect())
    assert tokens() == tokens(ledger=kept) == tokens(files="sessions") == [881] and tokens(files="unified") == []
    every = api.usage_report(spark, "models", "all", {"grok": str(tmp_path)}, price_table(spark)).rows.first()
    assert (every["input_tokens"], every["proxy_entries"], every["real_cost"]) == (881, 1, 0.0) and every["estimated_cost"] > 0
    assert api.facts(spark, "all", {"gx": str(tmp_path)}, options={"grok": {"files": "unified"}}).count() == 0
    write(log, {"ts": "2026-01-01T00:00:00Z", "sid": "s", "msg": grok.DONE, "ctx": {"prompt_tokens": 26}})
    assert tokens() == tokens(ledger=kept) == [26] and tokens(files="sessions") == [881]
    write(log, f'{{"msg": "{grok.DONE}", "ctx": 5}}')
    assert tokens(ledger=kept) == [26] and tokens() == []
    log.unlink()
    assert tokens(ledger=kept) == [26] and tokens() == [881]
    with pytest.raises(ValueError, match="files"):
        tokens(files="some")
