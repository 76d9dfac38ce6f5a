import random
import time

import corpus_pipeline
import numpy as np
from strandline.llm import nearcopies
from test_simhash import plain_fingerprint


def plain_jaccard(a, b):
    def parts(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    return len(parts(a) & parts(b)) / len(parts(a) | parts(b))


def plain_kept(rows):
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if plain_jaccard(x, y) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(doc for doc in root if root[doc] == doc)


def test_links_match_all_pairs(spark):
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    notice, texts = some(60), []
    for size, edits in [(30, 3), (25, 6), (40, 1), (20, 2), (5, 0)]:
        middle = some(rng.choice([40, 120, 300]))
        for _ in range(size):
            words = list(middle)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(words))
    walk = some(100)
    for step in range(15):  # neighbours are near, ends are not
        walk[6 * step] = f"y{step}"
        texts.append(" ".join(walk))
    texts += [" ".join(notice + some(rng.randint(5, 30))) for _ in range(40)]  # most shingles held by all of them
    texts += ["", " \n", None, "one", "One", "one two", "a b c d e", "a b c d e f", "A B C D E"] + [" ".join(some(50)) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string").repartition(3)
    kept = nearcopies.representatives(df)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *plain_kept(rows)]
    assert nearcopies.representatives(df.limit(0)).count() == 0


def test_vectors_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 400, 5000):
        for edits in (0, 1, size // 9, size // 3):
            a = rng.integers(0, 2**64, size, np.uint64, endpoint=False)
            b = np.concatenate([a[edits:], rng.integers(0, 2**64, edits, np.uint64, endpoint=False)])
            apart = len(np.setxor1d(a, b))
            differ = sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(nearcopies.parities(a), nearcopies.parities(b)))
            assert differ <= apart and (apart - differ) % 2 == 0


def test_stage_drops_copies_beyond_three_bits(spark, tmp_path):
    rng = random.Random(0)
    words = [f"word{rng.randint(0, 10**6)}" for _ in range(120)]
    text, near, far = " ".join(words), " ".join(words[:40] + ["changed"] + words[41:90] + ["again"] + words[91:]), " ".join(words[:60])
    assert (plain_fingerprint(text) ^ plain_fingerprint(near)).bit_count() > 3 and 0.8 <= plain_jaccard(text, near) < 1 and plain_jaccard(text, far) < 0.8
    docs = spark.createDataFrame([(1, text, "en"), (2, near, "en"), (3, far, "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_many_texts_that_share_most_but_not_enough(spark):
    """All hold the same 100 shingles and 14 of their own: similarity 0.78, and no text is held against all others."""
    rows = spark.range(32_000).selectExpr("id as doc_id", "concat_ws(' ', concat_ws(' ', transform(sequence(1, 104), i -> concat('common', i))), concat_ws(' ', transform(sequence(1, 14), i -> concat('own', id, 'x', i)))) as text").repartition(8)
    rows = rows.unionByName(spark.createDataFrame([(10**6, rows.filter("doc_id = 77").first().text + " end")], "doc_id long, text string")).cache()
    began = time.time()
    kept = nearcopies.representatives(rows)
    assert kept.count() == 32_000 and kept.filter("doc_id = 77").count() == 1
    assert time.time() - began < 240


def test_rows_with_one_id_are_told_apart(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, b + " end"), (2, a + " end"), (3, b), (7, c), (7, c + " end"), (None, a), (9, c + " more"), (11, b), (11, b)]
    kept = nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or -1, r.text) for r in kept if r.doc_id != 7)) == sorted([(1, a), (2, b + " end"), (-1, a)])
    assert [r.doc_id for r in kept].count(7) == 1


def test_keys_of_many_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "_HOT", 3)
    test_links_match_all_pairs(spark)
