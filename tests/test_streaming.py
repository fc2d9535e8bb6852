"""Streams over small files, run to completion, against what batches give."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import dedup, reports
from tallyforge.schema import USAGE
from tallyforge.sources import grok
from tallyforge.streaming import log_table
from tallyforge.streaming.ledgers import Ledger, best_candidates, blocks

ROWS = "key string, ord long, value long"


def run(query):
    query.processAllAvailable()
    query.stop()


def table_of(rows):
    return sorted(map(tuple, rows.collect()))


def test_ledger_survives_its_source(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", ROWS, "key", "ord")
    source = f"{tmp_path}/in"
    for i, rows in enumerate([[("a", 1, 10), ("b", 1, 20)], [("a", 2, 11), ("a", 3, 12)]]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("overwrite" if not i else "append").parquet(source)
        run(ledger.follow(spark.readStream.schema(ROWS).parquet(source), f"{tmp_path}/check").start())
    want = [("a", 3, 12), ("b", 1, 20)]
    assert table_of(ledger.read()) == want
    ledger.merge(spark.createDataFrame([("z", 9, 9)], ROWS), 0)  # a repeated batch changes nothing
    assert table_of(ledger.read()) == want


def bytes_of(folder) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_what_is_written_follows_the_batch(spark, tmp_path, monkeypatch):
    """Segments are merged in levels: their number, and that of the files, stays bounded; a batch does not rewrite the table."""
    monkeypatch.setattr(log_table, "FAN", 3)
    ledger = Ledger(spark, f"{tmp_path}/ledger", ROWS, "key", "ord")
    ledger.add(spark.range(50_000).selectExpr("concat('k', id) AS key", "0L AS ord", "id AS value"))
    whole, want, r = bytes_of(tmp_path / "ledger"), {f"k{i}": i for i in range(50_000)}, random.Random(3)
    for n in range(1, 14):
        changed = {f"k{r.randrange(50_050)}": 10**6 + n for _ in range(4)}
        want |= changed
        before = bytes_of(tmp_path / "ledger")
        ledger.add(spark.createDataFrame([(k, n, v) for k, v in changed.items()], ROWS).coalesce(1))
        if ledger.manifest().segments[-1].level == 0:
            assert bytes_of(tmp_path / "ledger") - before < whole / 20
        levels = [s.level for s in ledger.manifest().segments]
        assert levels == sorted(levels, reverse=True) and max(map(levels.count, levels)) < 3
    assert {x["key"]: x["value"] for x in ledger.read().collect()} == want
    assert len(list((tmp_path / "ledger/segments").iterdir())) <= 2 * 3 * 3 and len(list((tmp_path / "ledger/manifest").glob("0*"))) <= 2
    ledger.add(spark.createDataFrame([], ROWS))
    ledger.add(spark.createDataFrame([(None, 1, 1)], ROWS))
    assert ledger.read().count() == len(want) and ledger.manifest().batch == 15


def test_a_lost_race_raises(spark, tmp_path):
    one, two = (Ledger(spark, f"{tmp_path}/ledger", ROWS, "key", "ord") for _ in range(2))
    assert one.read().count() == 0
    one.add(spark.createDataFrame([("a", 1, 1)], ROWS))
    seen = two.manifest()
    one.add(spark.createDataFrame([("a", 2, 2)], ROWS))
    held = sorted(p.name for p in (tmp_path / "ledger/segments").iterdir())
    with pytest.raises(log_table.Conflict):
        two.commit(seen, spark.createDataFrame([("b", 1, 1)], ROWS), seen.batch + 1)
    assert table_of(two.read()) == [("a", 2, 2)] and sorted(p.name for p in (tmp_path / "ledger/segments").iterdir()) == held
    two.add(spark.createDataFrame([("b", 1, 1)], ROWS))
    assert table_of(one.read()) == [("a", 2, 2), ("b", 1, 1)]


def test_a_reader_of_the_last_manifest_can_finish(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_table, "FAN", 2)
    ledger = Ledger(spark, f"{tmp_path}/ledger", ROWS, "key", "ord")
    ledger.add(spark.createDataFrame([("a", 1, 1)], ROWS))
    reading = ledger.read()
    ledger.add(spark.createDataFrame([("a", 2, 2)], ROWS))  # merges both segments
    assert table_of(reading) == [("a", 1, 1)] and table_of(ledger.read()) == [("a", 2, 2)]
    ledger.add(spark.createDataFrame([("c", 2, 2)], ROWS))
    assert len(list((tmp_path / "ledger/segments").iterdir())) == len(ledger.manifest().segments) + len(ledger.manifest().retired)


NAMES = [x.split()[0] for x in USAGE.split(", ")]


def usage(rows):
    zero = dict.fromkeys((n for n in NAMES if n.endswith("tokens") or n.startswith("cache")), 0)
    base = zero | dict(source="t", session_key="s", session_id="s", file_path="f", cost_kind="real", call_count=1, model="m")
    return [tuple((base | row | {"line_ord": i}).get(n) for n in NAMES) for i, row in enumerate(rows)]


def streamed(spark, folder, batches, query, name):
    """The rows that a stream emits, fed with one batch after the other."""
    source = f"{folder}/in-{name}"
    spark.createDataFrame([], USAGE).write.parquet(source)
    stream = query(spark.readStream.schema(USAGE).parquet(source)).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/check-{name}").start()
    try:
        for batch in batches:
            spark.createDataFrame(batch, USAGE).coalesce(1).write.mode("append").parquet(source)
            stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.table(name)


def test_best_candidates_of_a_stream(spark, tmp_path):
    """Completions that come late, ids in several days, ties, rows without an id: the emitted rows say what the whole stream says."""
    r, hour = random.Random(6), 3600 * 1000
    rows = [{"message_id": r.choice([None, f"m{r.randrange(30)}", f"source-wide:w{r.randrange(10)}"]), "session_key": f"s{r.randrange(2)}", "stop_reason": r.choice([None, "end"]), "timestamp_ms": (i // 8) * hour + r.randrange(3) * hour, "input_tokens": i} for i in range(400)]
    made = usage(rows)
    emitted = streamed(spark, tmp_path, [made[:150], made[150:300], made[300:]], lambda s: best_candidates(s, "6 hours"), "candidates")
    whole = spark.createDataFrame(made, USAGE)
    key = lambda df: sorted(map(str, df.select("message_id", "session_key", "input_tokens", "stop_reason", "timestamp_ms").collect()))
    assert key(dedup.best_candidate(emitted)) == key(dedup.best_candidate(whole))
    assert emitted.count() < 400 and emitted.columns == NAMES


def test_late_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    day = 24 * 3600 * 1000
    batches = [usage([{"message_id": "a", "timestamp_ms": day, "stop_reason": "end", "input_tokens": 1}]), usage([{"message_id": "b", "timestamp_ms": 9 * day, "input_tokens": 2}]), usage([{"message_id": "a", "timestamp_ms": day + 5, "stop_reason": "end", "input_tokens": 3}])]
    emitted = streamed(spark, tmp_path, batches, best_candidates, "late")
    assert {x["input_tokens"] for x in emitted.collect()} == {1, 2}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_blocks_of_a_stream(spark, tmp_path, zone):
    """Around the hour that clocks in Berlin show twice, with rows that come hours late."""
    r, start = random.Random(7), 1729972800000  # 2024-10-26 20:00 UTC
    rows = [{"message_id": f"m{i}", "timestamp_ms": start + i * 240_000 - r.randrange(0, 3) * 3600 * 1000, "input_tokens": i, "output_tokens": 1, "model": f"k{i % 2}", "stop_reason": "end"} for i in range(300)]
    made = usage(rows)
    name = f"blocks_{zone[:3].lower()}"
    emitted = streamed(spark, tmp_path, [made[:90], made[90:180], made[180:]], lambda s: blocks(s, zone, "4 hours"), name)
    keys = ["block_start", "utc_offset", "model"]
    last = emitted.groupBy(*keys).agg(*[F.max_by(c, "entries").alias(c) for c in ("input_tokens", "output_tokens", "entries")])
    batch = reports.blocks(spark.createDataFrame(made, USAGE), zone, "model").select(*keys, "input_tokens", "output_tokens", "entries")
    show = lambda df: sorted(tuple(map(str, x)) for x in df.select(*batch.columns).collect())
    assert show(last) == show(batch) and emitted.count() > batch.count()


def test_durable_inferences(spark, tmp_path):
    """A log that grows, goes and comes back broken: what was read once stays."""
    log = tmp_path / "logs/unified.jsonl"
    log.parent.mkdir()
    line = lambda n: f'{{"ts":"2026-01-01T00:00:0{n}Z","sid":"s","msg":"{grok.DONE}","ctx":{{"loop_index":{n},"prompt_tokens":{n + 10}}}}}\n'
    tokens = lambda: sorted(r["input_tokens"] for r in grok.durable(spark, str(tmp_path), f"{tmp_path}/kept").collect())
    log.write_text(line(1) + line(2))
    assert tokens() == [11, 12]
    log.write_text(line(2) + line(3))
    assert tokens() == [11, 12, 13]
    log.write_text(line(4) + f'{{"msg": "{grok.DONE}", "ctx": 5}}\n')
    assert tokens() == [11, 12, 13]
    log.unlink()
    assert tokens() == [11, 12, 13]
