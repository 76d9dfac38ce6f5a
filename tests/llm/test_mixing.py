import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing

ROWS = [(i, "w " * (i % 37 + 1), f"s{i % 3}") for i in range(900)] + [(5000 + i, "word " * 20, None) for i in range(200)] + [(6000 + i, "x " * 9, "small") for i in range(12)]
ODD = [(7000, None, "s0"), (7001, "", "s1"), (7002, " \t", "none"), (7003, "long " * 20_000, "s2"), (None, "a b", "s0"), (7, "w w", "s1"), (7, "w w", "s1")]


def shares(sizes, most=3):
    """Targets by sharing again and again until no source is above its ceiling."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while True:
        total = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total >= most * sizes[n]] if free else []
        if not over:
            break
        for n in over:
            target[n] = most * sizes[n]
            free.remove(n)
        left = sum(sizes.values()) - sum(target.values())
    return target | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}


def test_mix(spark):
    df = spark.createDataFrame([(*r, "t") for r in ROWS + ODD], "doc_id long, text string, source string, target string").repartition(5)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ROWS + ODD)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    largest = {n: max(r.size for r in rows if r.source == n) for n in sizes}
    assert all(abs(taken[n] - want[n]) <= max(1.0 * largest[n], 0.03 * want[n]) for n in sizes)
    again = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(df.repartition(2)).collect() if r.doc_id not in (7, None)}
    assert again == {(r.doc_id, r.source, r.size): r.copies for r in rows if r.doc_id not in (7, None)}
    out = mixing.emit(df)
    assert out.count() == sum(r.copies for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r)[3:] for r in mixing.mix(blank).collect()] == [(0, 0, 0.0, 0, 0)]


def test_many_rows_that_are_alike(spark, monkeypatch):
    """Rows without ids and of one text fill many parts, and come out as one source's mix should."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int"))).otherwise("a b c").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(3000).select((F.col("id") + 10**6).alias("doc_id"), F.lit("x y z").alias("text"), F.lit("other").alias("source")))
    dealt = []
    deal = mixing._deal_alike
    monkeypatch.setattr(mixing, "_deal_alike", lambda *a: dealt.append(deal(*a)) or dealt[-1])
    mixed = mixing.mix(rows).cache()
    counts = dealt[0][0].groupBy("__source", "__class", *dealt[0][1]).count()
    assert counts.count() > 50 and counts.agg(F.max("count")).first()[0] <= 2 * mixing.ALIKE * mixing.PART_ROWS
    assert mixed.count() == 63_000
    for r in mixed.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("copies")).collect():
        assert r.size == r.source_size and abs(r.taken - r.target) <= 10 and r.copies <= 3
    expected = shares({"s": mixed.filter("source = 's'").agg(F.sum("size")).first()[0], "other": 9000})
    assert {r.source: r.target for r in mixed.select("source", "target").distinct().collect()} == pytest.approx(expected)


def test_many_sources(spark):
    """Names in order take their weights in turn; no window holds all of them, and shares match the plain rule."""
    rng = random.Random(4)
    sizes = {f"{rng.getrandbits(40):x}.example" + "é" * (i % 2): int(1.6 ** rng.randint(0, 30)) for i in range(3000)} | {None: 55, "": 3}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    plan = mixing._by_name(sources)
    assert [r.source for r in plan.orderBy("place").collect()] == sorted(n for n in sizes if n is not None) + [None]
    got = {r.source: r.target for r in mixing.targets(sources, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(shares(sizes))
