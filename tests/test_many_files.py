"""Folders of many files, whose listing the driver does not hold, beside Spark's readers and SQL."""

import io
import os
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from test_larger_keys import larger, same  # noqa: F401

from tallyforge.log_queries import streamed_root, turns_root, wire_root
from tallyforge.sources import claude, grok, kimi, many
from tallyforge.sources.base import json_lines, text_files, whole_text


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def few(monkeypatch):
    """As if a dozen files were many."""
    monkeypatch.setattr(many, "FEW_FILES", 12)


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 20])
def test_pieces_are_the_lines_of_a_part(monkeypatch, block):
    monkeypatch.setattr(many, "BLOCK", block)
    r = random.Random(block)
    for _ in range(300):
        text = b"".join(r.choice([b"a", b"bc", b"\n", b"\r\n", b"\n\n"]) for _ in range(r.randint(0, 20)))
        for part in (1, 2, 5, 7, 100):
            got = [p for s in range(0, len(text), part) for p in many.pieces(io.BytesIO(text), s, min(s + part, len(text)))]
            assert b"".join(t for _, t in got) == text and all(text[at : at + len(t)] == t for at, t in got)
            assert all(t.endswith(b"\n") for _, t in got[:-1])


def test_listing_in_tasks_finds_what_spark_reads(spark, tmp_path, few, monkeypatch):
    """Deep and wide folders, names that readers pass over, line ends of all kinds, a byte order mark, empty files and long ones."""
    monkeypatch.setattr(many, "OPENED", 2)
    r, root = random.Random(5), tmp_path / "a b%2F+c"
    for n in range(120):
        folder = root.joinpath(*r.choices(["p", "q%41", "_s", ".t", "_k=1", "ü v"], k=r.randint(0, 5)))
        folder.mkdir(parents=True, exist_ok=True)
        text = b"".join(r.choice([b"{}", "ä".encode(), b"\xff", b"\n", b"\r\n", b"\r"]) for _ in range(r.randint(0, 30)))
        (folder / r.choice([f"{n}.jsonl", f"{n}.txt", f"_{n}.jsonl", f"{n}.jsonl._COPYING_"])).write_bytes(r.choice([b"", b"\xef\xbb\xbf"]) + text)
    (root / "long.jsonl").write_bytes(b"x" * 70_000 + b"\n" + b"".join(b"%d\n" % i for i in range(50_000)))
    folder = str(root)
    below = many.Below.of(spark, folder, "*.jsonl")
    lines = lambda rows: sorted(map(tuple, rows.select("file_path", F.hex("value")).collect()))
    path = F.regexp_replace(F.expr("try_url_decode(replace(_metadata.file_path, '+', '%2B'))"), "^file:/+", "file:///")
    read = lambda **o: text_files(spark, folder, "*.jsonl", **o).select(path.alias("file_path"), "value")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        found, want = below.lines("*.jsonl"), lines(read())
        assert lines(found) == want and len(want) > 50_000
        order = [x["value"] for x in found.where("file_path LIKE '%long%'").orderBy("line_ord").collect()]
        assert order[1:] == [str(i) for i in range(50_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines(below.texts("*.jsonl")) == lines(read(wholetext=True)) == lines(whole_text(spark, folder, "*.jsonl"))


def test_few_files_and_patterns_are_left_to_spark(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text('{"n": 1}\n')
    assert many.Below.of(spark, str(tmp_path), "*.jsonl").files is None and many.Below.of(spark, f"{tmp_path}/a/x.jsonl", "x.jsonl").files is None
    assert json_lines(spark, f"{tmp_path}/[ab]", "n bigint").select("j.n").first()["n"] == 1
    assert many.store("s3a://bucket/key") is None and many.store("file:/a/b")[1:] == ("/a/b", "file://")


def test_a_listing_stays_out_of_the_driver(spark, tmp_path, few):
    for n in range(40):
        os.makedirs(tmp_path / f"sessions/p/g{n}")
        (tmp_path / f"sessions/p/g{n}/updates.jsonl").write_text("{}\n")
        (tmp_path / f"sessions/p/g{n}/summary.json").write_text("{}")
    for rows in (grok.sessions(spark, str(tmp_path)), json_lines(spark, f"{tmp_path}/sessions", "n bigint", "updates.jsonl"), whole_text(spark, str(tmp_path), "summary.json")):
        assert "Scan text" not in plan_of(rows) and not any("sessions/p" in f for f in rows.inputFiles())


def test_turns_of_many_files(spark, larger, few):  # noqa: F811
    rows = grok.turns(spark, turns_root(spark, larger))
    plan = plan_of(rows)
    assert plan.index("Join") > plan.rindex("from_json(StructField(timestamp") and plan.count("Join") == 1  # of files, below the reading of their lines
    assert same(spark, "turns_scan", larger)


def test_updates_are_read_once_for_snapshots(spark, larger):  # noqa: F811
    assert plan_of(grok.snapshots(spark, turns_root(spark, larger))).count("Scan text") == 3  # updates, summaries and signals


def test_sessions_without_a_log_of_many_files(spark, larger, few):  # noqa: F811
    assert same(spark, "sessions_without_a_log", larger)


def test_two_sources_of_many_files(spark, larger, few):  # noqa: F811
    rows = kimi.scan(spark, wire_root(spark, larger))
    assert len(re.findall("Scan text", plan_of(rows))) == 1  # the index
    assert "Scan text" not in plan_of(claude.scan(spark, streamed_root(spark, larger)))
    assert same(spark, "ranges_of_two_sources", larger) and same(spark, "wire_scan", larger)


def test_all_sources_of_many_files(spark, larger, few):  # noqa: F811
    assert same(spark, "all_sources_with_estimates", larger)


def test_a_line_is_parsed_once(spark, larger):  # noqa: F811
    rows = grok.turns(spark, turns_root(spark, larger))
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert plan.count("from_json(StructField(timestamp") == 1  # not once more for each filter


def test_a_model_that_comes_twice_is_summed(spark, tmp_path):
    """The rest of a turn goes to its default model, also where the turn names that model itself."""
    import json

    usage = {"inputTokens": 100, "modelUsage": {"base": {"inputTokens": 30}, "other": {"inputTokens": 20}}}
    (tmp_path / "sessions/p/s").mkdir(parents=True)
    (tmp_path / "sessions/p/s/summary.json").write_text(json.dumps({"current_model_id": "base"}))
    (tmp_path / "sessions/p/s/updates.jsonl").write_text(json.dumps({"timestamp": 1, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": "q", "usage": usage}}}) + "\n")
    assert sorted((r["model"], r["input_tokens"]) for r in grok.turns(spark, str(tmp_path)).collect()) == [("base", 80), ("other", 20)]
