import hashlib
import random
import re

import pytest

from strandline.llm import infill

DOCS = "doc_id long, text string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(4)
    alphabet = ["a", "é", "<", ">", "P", "S", "M", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "　", "😀", "word", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.choice([1, 3, 20, 200]))) for _ in range(300)]
    texts += [None, "", " ", "\n \t", "one", " one ", "a <P> b", "x<S>", "<M>", "<<S", "S> <P", "w " * 200_000, "w" * 500_000, " " * 300_000 + "x", "<" * 50]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, "no id at all here"), (None, None), out[5], (5, "another text with this id")]


def test_against_plain_version(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "x") for r in given], DOCS + ", output string").repartition(3)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.transform(df).collect()), key=repr)
    assert got == sorted(((doc_id, *plain_form(doc_id, text)) for doc_id, text in given), key=repr)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_texts_come_back(spark):
    given = rows()
    out = infill.transform(spark.createDataFrame(given, DOCS))
    back = sorted(((r.doc_id, r.text) for r in infill.restore(out).collect()), key=repr)
    assert back == sorted(((doc_id, text or "") for doc_id, text in given), key=repr)
    assert [r.text for r in infill.restore(spark.createDataFrame([(1, None, None)], "doc_id long, form string, output string")).collect()] == [""]


def test_digests_of_every_form(spark):
    given = rows()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digests(spark.createDataFrame(given, DOCS)).collect()), key=repr)
    assert got == sorted(((doc_id, sha(plain_form(doc_id, text)[4]), sha(text or "")) for doc_id, text in given), key=repr)


def test_other_parameters_and_ids(spark):
    df = spark.createDataFrame([(f"k{i}", f"text number {i}") for i in range(50)], "doc_id string, text string")
    assert {r.form for r in infill.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.transform(df, rate=100, spm=0).collect()} == {"psm"}
    assert infill.transform(df, seed=1).collect() != infill.transform(df, seed=2).collect()


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert infill.digests(empty).count() == infill.transform(empty).count() == infill.restore(infill.transform(empty)).count() == 0


@pytest.mark.parametrize("limit", [1, 100])
def test_slices_of_bounded_bytes(limit, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(infill, "SLICE_BYTES", limit)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (0, 60, 60, 0, 500, 1, 1, 1)] + [None])], names=["doc_id", "text"])
    parts = list(infill._slices(batch, 1))
    assert pa.Table.from_batches(parts).combine_chunks().to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.to_pydict()["text"]) <= limit for p in parts)
