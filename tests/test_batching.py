import random

import pytest

from strandline.operators import batching, embedding


def folded(rows, most_rows, most_tokens):
    """The calls by going through each group's rows one by one."""
    out, state = [], {}
    for group, id_, tokens in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1], r[2])):
        batch, n, total = state.get(group, (0, 0, 0))
        if n >= most_rows or n and total + tokens > most_tokens:
            batch, n, total = batch + 1, 0, 0
        state[group] = (batch, n + 1, total + tokens)
        out.append((group, batch, id_, tokens))
    return sorted(out, key=repr)


def check(spark, rows, most_rows, most_tokens):
    df = spark.createDataFrame(rows, "group string, id long, tokens long").repartition(3)
    assert sorted(map(tuple, batching.cut(df, most_rows, most_tokens).collect()), key=repr) == folded(rows, most_rows, most_tokens)


@pytest.mark.parametrize("block", [1, 7, 40, 10_000])
def test_same_calls_as_going_through(spark, monkeypatch, block):
    """Blocks shorter than a call, as long, and longer; composed over several levels."""
    monkeypatch.setattr(batching, "BLOCK_ROWS", block)
    monkeypatch.setattr(batching, "FAN", 3)
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.choice([1, 5, 9, 30, 120])) for i in range(160)]
    rows += [("ties", 1, 5), ("ties", 1, 5), ("ties", 1, 9), ("lone", 1, 500)]
    check(spark, rows, 10, 100)


@pytest.mark.parametrize("tokens", [1, 99, 1000], ids=["by rows", "by tokens", "each alone"])
def test_one_long_sequence(spark, monkeypatch, tokens):
    monkeypatch.setattr(batching, "BLOCK_ROWS", 100)
    check(spark, [("one", i, tokens) for i in range(2500)], 45, 300)


def test_limits_and_empty_tables(spark):
    assert embedding.batches(spark.createDataFrame([], "id long, tokens long")).count() == 0
    rows = [(i, 40_000 if i == 3 else 30_000) for i in range(6)] + [(None, 1)]
    got = embedding.batches(spark.createDataFrame(rows, "id long, tokens long")).collect()
    assert sorted((r.batch, r.id or -1) for r in got) == [(0, -1), (0, 0 or -1), (0, 1), (0, 2), (1, 4), (1, 5)]
    assert got[0].asDict().keys() == {"group", "batch", "id", "tokens"}


def test_no_task_holds_a_long_group(spark, monkeypatch):
    """A group of many blocks: no block is much larger than meant."""
    monkeypatch.setattr(batching, "BLOCK_ROWS", 500)
    seen = []
    materialize = batching.materialize
    monkeypatch.setattr(batching, "materialize", lambda df, name: seen.append((name, materialize(df, name))) or seen[-1][1])
    df = spark.range(20_000).selectExpr("'g' as group", "id", "cast(id % 700 + 1 as long) as tokens").repartition(4)
    assert batching.cut(df, 50, 9000).count() == 20_000
    dealt = dict(seen)["call-rows"]
    sizes = [r[1] for r in dealt.selectExpr("shiftright(__at, 33) as b").groupBy("b").count().collect()]
    assert max(sizes) < 2000 and len(sizes) > 20
