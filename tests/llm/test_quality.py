import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
import pytest

from strandline.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_base_figures(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 2, "x\nx\n \n\nx \n", "é\u00a0ü # $$", "w " * 30_000, "\x1c a \x85 b"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice("ab#") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 90))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string").repartition(4)
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_windows_whose_hashes_clash(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(20, 90))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    rows = quality.judge(df, lambda parts: f"pmod({quality.window_hash(parts)}, 5)").collect()
    assert [r.n_repeat_words for r in sorted(rows, key=lambda r: r.doc_id)] == [base(t)[4] for t in texts]


def test_no_language_is_not_the_empty_one(spark):
    rng = random.Random(12)
    said = {None: "uno dos tres cuatro".split(), "": "one two three four".split()}
    rows = [(i, " ".join(rng.choice(said[lang]) + rng.choice("abcdefgh") * rng.randint(0, 1) for _ in range(100)), lang) for i, lang in enumerate([None, ""] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lists = {r.lang: r.common for r in quality.common_words(df).collect()}
    assert set(lists) == {None, ""} and "uno" in lists[None] and "one" in lists[""] and not set(lists[None]) & set(lists[""])
    assert all(r.word_distance < 0.3 for r in quality.judge(df).collect())


def test_rare_words_fill_the_list(spark):
    """A language whose words are all rare has its list of common words too."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(6000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 100]), "xx") for i in range(60)], "doc_id long, text string, lang string")
    assert [len(r.common) for r in quality.common_words(df).collect()] == [quality.COMMON_WORDS]
    assert all(r.word_distance is not None for r in quality.judge(df).collect())


def test_distance(spark):
    def plain(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        term = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return math.sqrt(sum(term(x, y) + term(y, x) for x, y in zip(p, q, strict=True)) / 2)

    cases = [([1.0, 2.0, 0.0], [3.0, 0.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([5.0, 5.0], [1.0, 1.0])]
    got = []
    for p, q in cases:
        names = [[f"{side}{i}" for i in range(len(p))] for side in "pq"]
        row = spark.createDataFrame([(*p, *q, sum(p), sum(q))], ", ".join(f"{c} double" for c in [*names[0], *names[1], "ps", "qs"]))
        got.append(row.select(quality._distance(names[0], "ps", names[1], "qs").alias("d")).first().d)
    assert got == pytest.approx([plain(*c) for c in cases]) and got[1] == pytest.approx(1)


def test_verdicts(spark):
    rng = random.Random(10)
    usual = "the of and to in that is was it for with as his on be at by he".split() + ["house", "water", "people", "letter"] * 3
    clean = [" ".join(rng.choice(usual) + rng.choice(["", "", ","]) for _ in range(120)) for _ in range(60)]
    noisy = [" ".join("".join(rng.choice("#$%&*") for _ in range(4)) + rng.choice(usual) for _ in range(120)) for _ in range(4)]
    short = ["$$$$ #### " * 12]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noisy + short)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect() if not r.base_failed}
    assert all(kept[i] for i in range(60) if i in kept) and not any(kept[i] for i in range(60, 64))
    assert quality.judge(df.limit(0)).count() == 0
