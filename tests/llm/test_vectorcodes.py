import math
import random

import numpy as np
import pytest

from strandline.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=16, count=64, rounds=2):
    """rows: (vec_id, embedding, label); all by loops over Python's whole numbers."""
    kept = [(v, [math.floor(256 * float(np.float32(x))) for x in e], g) for v, e, g in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // parts) * parts
    step = width // parts
    kept = [(v, e + [0] * (width - len(e)), g) for v, e, g in kept]
    cut = lambda e: [e[p * step : (p + 1) * step] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:count]
    books = [[cut(e)[p] for _, e, _ in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, e, _ in kept:
                groups.setdefault(near(cut(e)[p], books[p])[1], []).append(cut(e)[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else entry for i, entry in enumerate(books[p])]
    out, totals = [], {}
    for v, e, g in kept:
        found = [near(cut(e)[p], books[p]) for p in range(parts)]
        out.append([v, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), g])
        totals[g] = totals.get(g, 0) + out[-1][2]
    return sorted(([v, code, error, totals[g]] for v, code, error, g in out), key=repr), books


def codes(spark, rows, schema=SCHEMA, **sizes):
    df = spark.createDataFrame(rows, schema).repartition(3)
    books = vectorcodes.fit(df, **sizes)
    coded = vectorcodes.with_group_error(vectorcodes.encode(df, books, keep=("vec_id", "label")))
    return sorted(([r.vec_id, r.code, r.error, r.label_error] for r in coded.collect()), key=repr), books


def some_rows(n, width=32, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    return rows + [(n + i, list(rows[3][1]), 7) for i in range(40)]  # one vector many times


def test_against_plain_version(spark):
    rows = some_rows(150)
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2), (904, [1.0, None] + [0.0] * 30, None), (-5, [0.0] * 99 + [None], 1)]
    rows += [(None, [0.5] * 32, None), (None, [0.25] * 32, None), rows[2], (2, [9.0] * 32, 3)]
    got, books = codes(spark, rows)
    expected, plain = plain_codes(rows)
    assert got == expected and books.entries == plain


@pytest.mark.parametrize("rows", [some_rows(10, 16), [(5, [1.0] * 16, None)], [(1, [0.1 * i for i in range(17)], 1), (2, [3.0], 1), (3, [], 2)], [(1, [], 1)]], ids=["few", "one", "ragged", "no components"])
def test_small_and_uneven_tables(spark, rows):
    got, books = codes(spark, rows)
    expected, plain = plain_codes(rows)
    assert got == expected and books.entries == plain


def test_no_rows(spark):
    for rows in ([], [(1, None, 1), (2, [None], 2)]):
        got, books = codes(spark, rows)
        assert got == [] and books.entries == [[]] * 16


def test_very_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 5, 6]) for _ in range(16)], 1) for i in range(90)]
    rows = [(v, [float(np.float32(x)) for x in e], g) for v, e, g in rows]
    got, books = codes(spark, rows)
    expected, plain = plain_codes(rows)
    assert got == expected and books.entries == plain
    assert [int(x) for x in vectorcodes.whole_numbers(np.array([1e300, -1e25, 0.5]))] == [int(1e300) * 256, int(-1e25) * 256, 128]


def test_search_keeps_ties_and_the_nearest():
    rng = np.random.default_rng(3)
    for width in (1, 2, 7):
        entries = rng.integers(-4, 4, (64, width))
        parts = rng.integers(-6, 6, (500, width))
        index, distance = vectorcodes.nearest(parts, entries)
        full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        wide = vectorcodes.nearest(parts.astype(object), entries)
        assert (wide[0] == index).all() and (wide[1] == distance).all()


def test_labels_beyond_what_is_told_to_all(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "_HOT_SHARE", 4)
    coded = spark.createDataFrame([(i, "00", i, i % 50 if i % 2 else None) for i in range(200)] + [(None, "00", 5, None)] * 3, "vec_id long, code string, error long, label int")
    totals = {}
    for r in coded.collect():
        totals[r.label] = totals.get(r.label, 0) + r.error
    got = vectorcodes.with_group_error(coded).collect()
    assert len(got) == 203 and all(r.label_error == totals[r.label] for r in got)


def test_a_vector_beyond_the_codebooks(spark):
    books = vectorcodes.fit(spark.createDataFrame(some_rows(5, 16), SCHEMA))
    with pytest.raises(Exception, match="longer than the codebooks"):
        vectorcodes.encode(spark.createDataFrame(some_rows(5, 32), SCHEMA), books).collect()
