from collections import Counter

import base64
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from test_nearcopies import plain_jaccard, plain_kept
from test_simhash import plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_a_plain_version(spark, tmp_path):
    words = "the of and house water people letter running river mountain garden winter summer".split()
    text = lambda i: " ".join(words[(i * k + k * k) % len(words)] + str(i % 7) for k in range(1, 60))
    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, text(3), "en", "s1", 0), (101, text(3), "en", "s2", 0), (102, "  ", "en", "s0", 0), (103, None, "en", "s0", 0), (104, "123 ...", "en", None, 0), (105, text(5) + " end", "en", None, 0)]
    rows += [(106, text(7).replace("water", "stream", 1), "en", "s1", 0)]  # near by its words, not by its fingerprint
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages, kept = dict(corpus_pipeline.STAGES), []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.read.parquet(str(tmp_path / ("documents.parquet" if not at else f"{at - 1}")))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(at)))
        kept.append(spark.read.parquet(str(tmp_path / str(at))).collect())
    spoken, unique, apart, mixed = kept
    assert {r.doc_id for r in spoken} == {r[0] for r in rows} - {102, 103, 104}
    by_text = {}
    for r in spoken:
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(by_text.values())
    assert sorted(r.doc_id for r in apart) == plain_kept([(r.doc_id, r.text) for r in unique])
    assert {105, 106} & {r.doc_id for r in unique} == {105, 106} and not {105, 106} & {r.doc_id for r in apart}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in apart} and max(copies.values()) <= 3
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(sum(len(r.text.split()) for r in apart), rel=0.2)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in apart}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == copies and all(r.n_tokens == len(peer.encode_ordinary(texts[r.doc_id])) for r in last)
    assert list(stages) == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources", "byte-level BPE"]


def test_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, very long and empty texts, further columns with the stages' own names; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, target string, size string, copies int, taken int, component_id string, at string, digest string"
    extra = ("mine", "mine", "mine", "mine", 7, 8, "mine", "mine", "mine")
    rows = [(i, f"the house of water number {i} stands near people {i * i} who write letters {i + 3} and read {i * 7} them", "en", None if i % 3 else "s", 0, *extra) for i in range(30)]
    rows += [(None, "a text without a number of its own", None, "s", 0, *extra), rows[3], (50, "long words " * 60_000, "en", "s", 0, *extra), (51, "", "en", "s", 0, *extra), (52, None, None, None, None, *extra)]
    for name, table in (("some", rows), ("none", [])):
        place = tmp_path / name
        docs = spark.createDataFrame(table, schema)
        docs.write.parquet(str(place / "documents.parquet"))
        docs = spark.read.parquet(str(place / "documents.parquet"))
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, str(place))
            assert out.columns == docs.columns
            out.write.parquet(str(place / str(at)))
            docs = spark.read.parquet(str(place / str(at)))
            kept = docs.collect()
            assert all(tuple(r)[5:] == extra for r in kept)
        last = corpus_pipeline.run(spark, str(place)).collect()
        assert len(last) == len(kept)
        if table:
            assert not {51, 52} & {r.doc_id for r in last}
