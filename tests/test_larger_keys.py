"""Queries beside their DuckDB SQL on events whose keys are those of larger tables."""

import duckdb
import pytest

from tallyforge.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables, with events in several copies with keys far apart."""
    folder = tmp_path_factory.mktemp("larger")
    duckdb.sql(f"COPY (SELECT event_id + i * 700000 AS event_id, ts, user_id + i * 1500 AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(3) r(i)) TO '{folder}/events.parquet'")
    return str(folder)


def same(spark, name, folder):
    """Whether a query gives the rows of its SQL."""
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
        got = queries()[name](spark, folder).toPandas()
        con.register("got", got)
        shown = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' if got[c].dtype == object else f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in got.columns)
        want = f"SELECT {shown} FROM ({oracle_sql()[name]})"
        mine = f"SELECT {shown} FROM got"
        assert con.execute(f"SELECT count(*) FROM ({mine})").fetchone() == con.execute(f"SELECT count(*) FROM ({want})").fetchone()
        assert con.execute(f"(({want}) EXCEPT ALL ({mine})) UNION ALL (({mine}) EXCEPT ALL ({want})) LIMIT 5").fetchall() == []
    return True


def test_weekly_value_of_logs(spark, larger):
    assert same(spark, "weekly_value_of_logs", larger)


def test_quota_report_json(spark, larger):
    assert same(spark, "quota_report_json", larger)


def test_quota_report_csv(spark, larger):
    assert same(spark, "quota_report_csv", larger)


def test_a_rate_that_is_not_there_is_an_empty_cell(spark):
    from tallyforge.operators.sinks import csv_rate

    rows = spark.sql("SELECT CAST(NULL AS DOUBLE) AS rate UNION ALL SELECT 12.345D")
    assert sorted(r[0] for r in rows.select(csv_rate(rows["rate"])).collect()) == ["", "12.35"]


def test_session_report_csv_orders_ties_by_session(spark, larger):
    assert same(spark, "session_report_csv", larger)


def listed_files(root):
    """(path, line) of every JSON file of a folder."""
    from pathlib import Path

    return [(p.name, line) for p in Path(root.removeprefix("file://")).rglob("*.json") for line in p.read_text().splitlines()]


def test_billing_documents_are_written_line_by_line(spark, larger):
    from tallyforge.log_queries import billing_root

    lines = listed_files(billing_root(spark, larger))
    assert max(len(line) for _, line in lines) < 1000  # an event, not a document
    assert len({name for name, _ in lines}) > 4  # more documents for more users
    assert same(spark, "billing_scan", larger)


def test_billing_pages_are_bounded(spark, larger):
    import re

    from tallyforge.log_queries import pages_root

    spans = {}
    for name, line in listed_files(pages_root(spark, larger)):
        ids = [int(x) for x in re.findall(r'"conversationId":"c(\d+)"', line)]
        spans.setdefault(name, set()).update(x // 1500 for x in ids)
        assert len(line) < 1000
    assert all(len(copies) == 1 for copies in spans.values())  # keys far apart are never one page
    assert same(spark, "billing_pages", larger)


def test_turns_are_summed_without_a_shuffle_of_their_lines(spark, larger):
    from tallyforge.log_queries import turns_root
    from tallyforge.sources import grok

    rows = grok.turns(spark, turns_root(spark, larger))
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert "Aggregate" not in plan and "sessionUpdate" in plan
    assert same(spark, "turns_scan", larger)


def test_the_log_of_inferences_is_rolled(spark, larger):
    from pathlib import Path

    from tallyforge.log_queries import telemetry_root

    logs = list(Path(telemetry_root(spark, larger).removeprefix("file://")).rglob("unified.jsonl"))
    assert len(logs) == 3  # 100,000 events at most in a file
    assert same(spark, "telemetry_scan", larger)


def test_only_the_index_of_the_root_is_listed(spark, tmp_path):
    import json

    from tallyforge.sources import kimi

    def write(path, line):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(line) + "\n")

    wire = {"type": "usage.record", "usageScope": "turn", "usage": {"inputOther": 1}, "time": 1}
    write(tmp_path / "sessions/wd_a_0123456789ab/S1/agents/main/wire.jsonl", wire)
    write(tmp_path / "sessions/wd_a_0123456789ab/S1/session_index.jsonl", {"sessionId": "S1", "workDir": "/not/this"})
    write(tmp_path / "session_index.jsonl", {"sessionId": "S1", "workDir": "/w"})
    assert [r["project_path"] for r in kimi.scan(spark, str(tmp_path)).collect()] == ["/w"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    from tallyforge.sources.base import LISTERS, text_files

    for n in range(120):
        (tmp_path / f"root/s{n}").mkdir(parents=True)
        (tmp_path / f"root/s{n}/a.jsonl").write_text("{}\n")
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        assert text_files(spark, str(tmp_path / "root"), "*.jsonl").count() == 120
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    first = context.statusTracker().getStageInfo(min(s for j in jobs for s in j.stageIds))
    assert first.numTasks <= LISTERS * context.defaultParallelism < 120
