import math
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandline.llm import langid

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def all_cuts(data, pieces):
    if not data:
        yield []
    for n in range(1, len(data) + 1):
        if data[:n] in pieces:
            for rest in all_cuts(data[n:], pieces):
                yield [data[:n], *rest]


def test_forward_is_the_sum_over_all_segmentations():
    pieces = sorted([b" ", b"a", b"b", b"c", b"ab", b" a", b"bc", b"abc", b"ca", b"abcabcab"])
    rng = np.random.default_rng(3)
    model = langid.PieceModel(["x", "y"], langid.Pieces(pieces), rng.dirichlet(np.ones(len(pieces)), 2).T)
    index = {p: i for i, p in enumerate(pieces)}
    words = ["abcabc", "c", "bbcaab", "", "abcabcabca"]
    product = lambda cut, lang: math.prod(model.probs[index[p], lang] for p in cut)
    sums = np.array([[sum(product(cut, lang) for cut in all_cuts(langid._spell(w), pieces)) for lang in (0, 1)] for w in words])
    assert model.word_scores(words) == pytest.approx(np.log(sums))
    # expectation by listing all cuts
    counts, langs = np.array([5, 2, 7, 1, 3]), np.array([0, 1, 1, 0, 0])
    want = np.zeros_like(model.probs)
    for word, n, lang, total in zip(words, counts, langs, sums):
        for cut in all_cuts(langid._spell(word), pieces):
            for p in cut:
                want[index[p], lang] += n * product(cut, lang) / total[lang]
    spelled = [langid._spell(w) for w in words]
    assert model.expected(langs, spelled, counts) == pytest.approx(want)
    assert langid.improved(model, want, 0.1).probs.sum(axis=0) == pytest.approx([1, 1])


def test_long_words_are_scored_whole():
    pieces = langid.read_pieces(PATH)
    model = langid.uniform(pieces, ["x", "y"])
    words = ["a" * 5000, "ab" * 10, "\u4e2d\u6587" * 3000, "the"]
    together, alone = model.word_scores(words), np.concatenate([model.word_scores([w]) for w in words])
    assert np.isfinite(together).all() and together == pytest.approx(alone)
    one = langid.PieceModel(["x"], langid.Pieces([b" ", b"a"]), np.array([[0.25], [0.75]]))
    assert one.word_scores(["a" * 4000])[0, 0] == pytest.approx(math.log(0.25) + 4000 * math.log(0.75))
    used = one.expected(np.zeros(1, np.int64), [langid._spell("a" * 4000)], np.array([2]))
    assert used[:, 0] == pytest.approx([2, 8000])


def test_every_piece_takes_part():
    pieces = langid.read_pieces(PATH)
    assert len(pieces) == 50_256
    table = langid.Pieces(pieces)
    assert sorted(table.row[table.row >= 0]) == list(range(len(pieces)))
    sample = [p for p in pieces if len(p) > 7][::50]
    for piece in sample:
        lattice = table.lattice([piece])
        whole = (lattice.starts == 0) & (lattice.ends == len(piece))
        assert pieces[lattice.rows[whole][0]] == piece


def test_cache_of_any_size_gives_the_same():
    pieces = langid.read_pieces(PATH)
    model = langid.uniform(pieces, ["en", "de"])
    model.probs[:] = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    texts = ["the and the", "der und die", "xyz", None, "", "12 !", "x\u00b2y und the der", "\u00bd \u00b2"] * 5
    plain = lambda totals: [None if t is None else list(t) for t in totals]
    got = plain(langid.Scorer(model, cached=1).totals(texts))
    assert got == plain(langid.Scorer(model).totals(texts))
    for text, total in zip(texts, got):
        words = langid.WORD.findall(text.lower()) if text else []
        assert (total is None) == (not words) and (not words or total == pytest.approx(list(model.word_scores(words).sum(axis=0))))


def test_rows(spark):
    train = [(i, "the cat and the dog of the house", "en") for i in range(30)] + [(100 + i, "der hund und die katze des hauses", "de") for i in range(30)]
    docs = spark.createDataFrame([*train, (None, "the dog", "en"), (900, None, "en"), (901, "123 ...", "de"), (902, "", None), (903, "die katze " * 30_000, None)], "doc_id long, text string, lang string")
    model = langid.train(docs, PATH)
    assert [m.langs for m in model] == [["de", "en"]]
    got = {(r.doc_id): (r.lang_pred, r.score) for r in langid.identify(docs.withColumn("score", docs.lang), model).collect()}
    apart = langid.train(docs, PATH, together=1)
    assert [m.langs for m in apart] == [["de"], ["en"]]
    for r in langid.identify(docs, apart).collect():
        assert (r.lang_pred, r.score) == (got[r.doc_id][0], pytest.approx(got[r.doc_id][1]))
    assert got[None][0] == "en" and got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "de"
    assert all(got[i][0] == "en" and 0.5 < got[i][1] <= 1 for i in range(30))
    empty = langid.train(docs.limit(0), PATH)
    assert empty == [] and {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, PATH)
    rows = langid.identify(docs, model, keep=("doc_id", "lang")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
