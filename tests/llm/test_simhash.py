import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import components, simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(parts))


def plain_components(rows):
    """rows: (doc_id, fp as unsigned); every pair is compared."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for doc, fp in rows:
        if doc is not None:
            least[find(fp)] = min(doc, least.get(find(fp), doc))
    return {(doc, fp): least.get(find(fp)) for doc, fp in rows}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "One two three", "a b c d a b c d", "É é Ü ß ok", "x y \x1c z", "w " * 70_000])
def test_fingerprint_of_a_text(text):
    assert int(simhash.fingerprints_of([text], 1)[0]) & (2**64 - 1) == plain_fingerprint(text)


def test_many_texts_at_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 50, 400]))) for _ in range(300)]
    got = [int(x) & (2**64 - 1) for x in simhash.fingerprints_of(texts, len(texts))]
    assert got == [plain_fingerprint(t) for t in texts]


def test_links_match_all_pairs(spark):
    rng = random.Random(5)
    fps = []
    for size, spread in [(60, 2), (60, 4), (1, 0), (40, 6), (30, 3)]:  # dense groups, chains and single ones
        middle = rng.getrandbits(64)
        for _ in range(size):
            fp = middle
            for b in rng.sample(range(64), rng.randint(0, spread)):
                fp ^= 1 << b
            fps.append(fp)
    chain = rng.getrandbits(64)
    for step in range(20):  # neighbours differ in three bits
        fps.append(chain)
        for b in range(3 * step, 3 * step + 3):
            chain ^= 1 << b
    fps += [rng.getrandbits(64) for _ in range(40)] + [0, 0, 7, 15, 2**63, 2**64 - 1] + fps[:5]
    rows = list(enumerate(fps))
    rng.shuffle(rows)
    df = spark.createDataFrame([(doc, fp - 2**64 if fp >= 2**63 else fp) for doc, fp in rows], "doc_id long, fp long").repartition(3)
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.link_fingerprints(df.cache()).collect()}
    assert got == plain_components(rows)


def test_links_of_keys_that_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_HOT", 2)
    test_links_match_all_pairs(spark)


def test_fingerprints_of_longer_shingles():
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(301)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.of_hashes(np.array(hashes, np.uint64)) & (2**64 - 1) == expected and simhash.of_hashes(np.array([], np.uint64)) == 0


def test_stars_find_pairs_within_three_bits(spark):
    rng = random.Random(6)
    middles = [rng.getrandbits(64) for _ in range(40)]
    fps = [m ^ sum(1 << b for b in rng.sample(range(64), n)) for m in middles for n in (0, 3)]
    df = spark.createDataFrame([(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in enumerate(fps)], "node long, fp long")
    assert {(r.a, r.b) for r in simhash.stars(df).collect()} == {(i, i + 1) for i in range(0, 80, 2)}


def test_a_hub_is_no_single_task(spark):
    """A star of many edges, and a chain beside it: minima of the hub are sent to its edges, which are dealt out."""
    star = spark.range(1, 300_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(400_000, 400_050).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = star.unionByName(chain).repartition(4)
    found = components.components(edges)
    assert found.filter("root = 0").count() == 300_000 and found.filter("root = 400000").count() == 50 and found.count() == 300_050
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    dealt = components._with_least(both, 300_050)
    assert dealt.filter("m is null").count() == 0
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 0.5 * sum(sizes)


def test_odd_rows(spark):
    rows = [(1, "same words here now"), (2, "same words here now"), (None, "same words here now"), (None, "on its own entirely here"), (5, None), (6, ""), (7, "a b"), (7, "c d"), (7, "a b"), (9, "c d")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.link(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x"))).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (None, None), (5, 5), (6, 5), (7, 7), (7, 7), (7, 7), (9, 7)], key=str)
    assert simhash.link(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.representatives(spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", component_id string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5, 7, 7, 7] and kept.columns == ["doc_id", "text", "component_id"]
