import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import metadata
from strandline.streaming import chat, tail

EVENTS = "chat_id string, seq int, kind string, body string"


def plain_steps(events):
    """One event after the other."""
    chats = {}
    for chat_id, _, kind, body in sorted(events, key=lambda e: (str(e[0]), e[1])):
        steps = chats.setdefault(chat_id, [])
        if kind == "tool_result":
            waiting = next((s for s in steps if s[0] == "tool_call" and s[2] is None), None)
            if waiting:
                waiting[2] = body or ""
        elif kind in ("thinking", "text") and steps and steps[-1][0] == kind:
            steps[-1][1] += body or ""
        else:
            steps.append([kind, body or "", None])
    return {(c, n): tuple(s) for c, steps in chats.items() for n, s in enumerate(steps)}


def some_events(seed, chats=6, length=40):
    rng = random.Random(seed)
    kinds = ["thinking", "thinking", "text", "text", "tool_call", "tool_result"]
    events = [(f"c{c}", n, rng.choice(kinds), rng.choice(["a", "bb ", "", None, "é"]) if n % 3 else f"{c}.{n}") for c in range(chats) for n in range(length)]
    return events + [("late", 0, "tool_result", "lost"), ("late", 1, "tool_call", "x"), ("late", 2, "tool_result", "kept"), (None, 0, "text", "no chat")]


def test_steps_of_a_table(spark):
    events = some_events(1)
    rows = chat.chat_steps(spark.createDataFrame(events, EVENTS).repartition(3)).collect()
    assert {(r.chat_id, r.step): (r.kind, r.body, r.result) for r in rows} == plain_steps(events) and len(rows) == len(plain_steps(events))
    assert chat.chat_steps(spark.createDataFrame([], EVENTS)).count() == 0


def run_batches(spark, tmp_path, batches, schema, build, key):
    """Each batch as a file of its own, one micro-batch each; what came last for each key."""
    source, seen, numbers = tmp_path / "in", {}, []
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

        def take(df, batch):
            numbers.append(batch)
            fresh = {}
            for r in df.collect():
                fresh.setdefault(key(r), []).append(r)
            seen.update(fresh)

        stream = build(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len(set(numbers)) >= len(batches)
    return seen


def test_steps_over_three_batches_are_those_of_the_table(spark, tmp_path):
    events = some_events(2, chats=4, length=30)
    batches = [[e for e in events if lo <= e[1] < hi] for lo, hi in ((0, 7), (7, 8), (8, 99))]
    seen = run_batches(spark, tmp_path, batches, EVENTS, chat.stream_steps, lambda r: (r.chat_id, r.step))
    table = chat.chat_steps(spark.createDataFrame(events, EVENTS)).collect()
    assert {k: tuple(v[0])[2:] for k, v in seen.items()} == {(r.chat_id, r.step): tuple(r)[2:] for r in table} == plain_steps(events)


@pytest.mark.parametrize("count", [1, 4])
def test_tail_over_batches_is_that_of_all_lines(spark, tmp_path, count):
    schema = "log string, ts timestamp, event_id long, message string"
    rng = random.Random(3)
    lines = spark.createDataFrame([(rng.choice(["a", "a", "a", "b"]), rng.randint(0, 5000), i, rng.choice(["Warning: slow", "failed", "ok", "done ✅"])) for i in range(300)], "log string, at long, event_id long, message string")
    lines = lines.select("log", F.timestamp_seconds("at").alias("ts"), "event_id", "message")
    rows = [tuple(r) for r in lines.collect()]  # ids come in any order of time: many lines are late
    batches = [rows[:120], rows[120:130] + rows[:5], rows[130:]]
    seen = run_batches(spark, tmp_path, batches, schema, lambda s: tail.rings(s, 20, count), lambda r: (r.log, r.ring))
    kept = spark.createDataFrame([tuple(r) for ring in seen.values() for r in ring], tail.RING)
    assert max(len(ring) for ring in seen.values()) <= 20
    for log in ("a", "b"):
        expected = [r.event_id for r in metadata.log_tail(lines.filter(F.col("log") == log), 20).collect()]
        got = tail.newest(kept, log, 20).collect()
        assert [r.event_id for r in got] == expected
        assert {r.message: r.level for r in got}.items() <= {"Warning: slow": "warning", "failed": "error", "ok": "info", "done ✅": "success"}.items()
