import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import spotsigs

DOCS = "doc_id long, text string"
WORDS = "the of and to house water river mountain winter letter garden people summer street window table bread".split()


def plain_signatures(text, chain=spotsigs.CHAIN):
    """The chains themselves in place of their hashes."""
    words = [w.lower() for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    content, run, runs = [], [], []
    for w in words:
        if w in spotsigs.ANCHORS:
            run.append(w)
        else:
            runs.append((tuple(run), len(content)))
            content.append(w)
            run = []
    found = {(anchors, *content[at : at + chain]) for anchors, at in runs if anchors}
    return found or ({tuple(words)} if words else set())


def plain_likeness(a, b, least=spotsigs.LEAST):
    if not a or not b:
        return float(not a and not b)
    return len(a & b) / len(a | b) if min(len(a), len(b)) >= least * max(len(a), len(b)) else 0.0


def plain_edits(rows, hashes):
    """Text and next text of each row; rows: (doc_id, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""], r[1] or ""), reverse=True)
    return [(doc_id, text or "", after[1] or "") for (doc_id, text), after in zip(order, order[1:] + order[:1])]


def check(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("signatures", F.lit("x")).repartition(3)
    hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    expected = []
    for doc_id, text, after in plain_edits(rows, hashes):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = plain_signatures(text), plain_signatures(edited), plain_signatures(after)
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(own), len(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, following), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, len(r.signatures), len(r.edited_signatures), round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.compare(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("size", [1, 4, 128], ids=["many ranges", "short ranges", "one range"])
def test_against_plain_version(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "_RANGE_ROWS", size)
    rng = random.Random(size)
    rows = [(3 * i, prose(rng, rng.choice([0, 1, 5, 60, 300]))) for i in range(90)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " .,\n"), (2003, "Für É über straße the House"), (2004, "😀 the 😀😀 of a b"), (-4, "the of and"), (None, prose(rng, 40)), (None, prose(rng, 40)), (None, None)]
    rows += [(5, prose(rng, 30)), (5, prose(rng, 50)), (5, prose(rng, 30))]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(1, "the house of water")], [(1, None)], [(None, "a text of its own")], [(7, "the same text here")] * 5, [(2, "one the more"), (1, "two of them all")]], ids=["one", "null", "no id", "repeated", "two"])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_no_rows(spark):
    assert spotsigs.compare(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    check(spark, [(1, prose(rng, 200_000)), (2, "x" * 400_000), (3, "the " * 100_000), (4, "short of words")])


def test_equal_texts_have_equal_fingerprints(spark):
    rng = random.Random(3)
    texts = [prose(rng, 50) for _ in range(20)]
    df = spark.createDataFrame([(i, texts[i % 20]) for i in range(60)], DOCS)
    rows = spotsigs.compare(df).select("doc_id", F.array_join("signatures", "").alias("fp")).collect()
    found = {}
    for r in rows:
        assert re.fullmatch("([0-9a-f]{16})*", r.fp)
        found.setdefault(r.doc_id % 20, set()).add(r.fp)
    assert all(len(fps) == 1 for fps in found.values()) and len({min(f) for f in found.values()}) == 20


def test_lengths_too_far_apart_are_never_compared(spark):
    df = spark.createDataFrame([([1], list(range(1, 30))), (list(range(20)), list(range(30))), ([], []), ([], [1]), ([1, 2], [3, 4])], "a array<long>, b array<long>")
    got = [round(r[0], 6) for r in df.select(spotsigs.likeness("a", "b", 0.5)).collect()]
    assert got == [0.0, round(20 / 30, 6), 1.0, 0.0, 0.0]
