import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import paths, text, vectors
from strandline.sources import pdf


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Rain fell. The river rose. Boats came.", ["Rain fell.", "The river rose.", "Boats came."]),
        ("Who rows? Nobody rows! They drift.", ["Who rows?", "Nobody rows!", "They drift."]),
        ("Oars.\nSails.\nRopes.", ["Oars..", "Sails..", "Ropes."]),
        ("a harbour without marks", ["a harbour without marks"]),
        ("a\n\nb", ["a.", ".", "b"]),
        ("v1.2 stays. ok", ["v1.2 stays.", "ok"]),
        ("", [""]),
    ],
)
def test_sentences(spark, value, expected):
    assert one(spark, value, text.sentences("v")) == expected


def test_text_expressions(spark):
    df = spark.createDataFrame([("  a \t b\u00a0c\n", "éé")], "v string, w string")
    row = df.select(text.clean_text("v").alias("c"), text.token_estimate("w").alias("t"), text.trim_space("v").alias("s")).first()
    assert (row.c, row.t, row.s) == ("a b c", 2, "a \t b\u00a0c")
    assert text.keywords("The Python, programming! of an é x") == ["python", "programming", "é"]
    assert one(spark, "The Python, programming! of an é x", text.keyword_column("v")) == ["python", "programming", "é"]
    assert [text.keyword_weight(w) for w in ("ab", "python", "programming")] == [1.0, 3.0, 5.0]
    assert one(spark, "x" * 600, text.preview("v")) == "x" * 500 + "..."
    assert one(spark, "a" + "é" * 600, text.preview("v")) == "a" + "é" * 249 + "..." and one(spark, "\U0001f600" * 125, text.preview("v")) == "\U0001f600" * 125
    assert one(spark, "data: {\"a\": 1}\nnoise\ndata: broken{\ndata: {\"b\": 2}", text.sse_events("v")) == ['{"a": 1}', '{"b": 2}']
    assert [one(spark, v, text.mask_secret("v")) for v in ("", "abc", "sk-123456")] == ["", "****", "****3456"]
    assert [one(spark, v, text.log_level("v")) for v in ("Warning: x failed", "it Failed", "✓ ok", "hello")] == ["warning", "error", "success", "info"]
    assert one(spark, "processed 12 files now", text.processed_files("v")) == 12
    assert one(spark, "x" * 200, text.plain_base64(F.encode("v", "UTF-8"))).count("\n") == 0


def test_paths(spark):
    kept = ["/r/a.txt", "/r/docs/b.MD", "/r/x.go"]
    dropped = ["/r/.hidden.txt", "/r/.git/a.txt", "/r/node_modules/a.js", "/r/vendor/v.go", "/r/a.exe", "/r/noext"]
    df = spark.createDataFrame([(p,) for p in kept + dropped], "path string")
    assert {r.path for r in df.filter(paths.scanned("path")).collect()} == set(kept)
    values = {"/r/a.TXT": "txt", "/r/Makefile": "unknown", "/r.d/x": "unknown"}
    assert {p: one(spark, p, paths.file_type("v")) for p in values} == values
    assert one(spark, "/a/b", paths.file_id("v")) == hashlib.md5(b"/a/b").hexdigest()
    assert [one(spark, v, paths.human_size(F.col("v").cast("long"))) for v in ("0", "10", "2048", "5242880")] == ["Unknown", "10 B", "2.0 KB", "5.0 MB"]
    assert one(spark, "C:\\Users\\x", paths.windows_to_wsl("v")) == "/mnt/c/Users/x"
    assert one(spark, "/a/b/c", paths.last_two("v")) == "b/c"
    assert [one(spark, v, paths.page_of_image("v")) for v in ("page_41_img_7.gif", "harbour.png", "map_of_page_12", "page_8_and_page_9.png", "page_x_img_3.png")] == [41, 1, 12, 8, 1]
    assert one(spark, "/Root/x/y", paths.inside("v", "/root/X")) and not one(spark, "/rootx/y", paths.inside("v", "/root"))


@pytest.mark.parametrize(
    ("value", "expected"),
    [("D:19991231235958", datetime(1999, 12, 31, 23, 59, 58)), ("20070703040506", datetime(2007, 7, 3, 4, 5, 6)), ("D:20110228220000-03'00'", datetime(2011, 3, 1, 1, 0)), ("20200229", datetime(2020, 2, 29)), ("someday", None), ("", None)],
)
def test_pdf_dates(spark, value, expected):
    found = one(spark, value, F.date_format(paths.pdf_date("v"), "yyyy-MM-dd HH:mm:ss"))
    assert found == (expected and expected.strftime("%Y-%m-%d %H:%M:%S"))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(vectors.cosine_distance("a", "b").alias("d")).collect()]
    assert got[0] == pytest.approx(0.006116, abs=1e-5) and got[1:] == [None, None]
    v = one(spark, "hello", vectors.hash_embedding("v", 100))
    raw = hashlib.sha256(b"hello").digest()
    plain = [int.from_bytes(raw[i * 4 % 32 : i * 4 % 32 + 4], "big") / 4294967295 * 2 - 1 for i in range(100)]
    size = sum(x * x for x in plain) ** 0.5
    assert v == pytest.approx([x / size for x in plain])
    q, d = hashlib.sha256(b"q").digest(), hashlib.sha256(b"doc").digest()
    score = sum(a == b for a, b in zip(q, d, strict=True)) / 32 + int.from_bytes(d[:4], "big") % 100 / 1000
    assert one(spark, "doc", vectors.hash_rerank_score(F.lit("q"), F.col("v"))) == pytest.approx(min(score, 1))
    assert one(spark, "1121", vectors.image_tokens(F.col("v").cast("int"))) == 3
    assert one(spark, "[1,2.5]", vectors.parse_vector("v")) == [1.0, 2.5]


def test_small_functions(spark):
    row = spark.range(1).select(
        vectors.vector_literal(F.array(F.lit(1.5), F.lit(-2.0))).alias("literal"),
        paths.stored_time(F.lit("2024-01-02 03:04:05")).cast("string").alias("plain"),
        paths.stored_time(F.lit("2024-01-02T03:04:05Z")).cast("string").alias("iso"),
        paths.stored_time(F.lit("never")).cast("string").alias("none"),
    ).first()
    assert tuple(row) == ("[1.5,-2.0]", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None)
    assert paths.plain_name("my docs (v2).d") == "my_docs__v2__d"
    info = spark.createDataFrame([("f", "/a/b.pdf", "  ", "me", "D:20240102030405", None, 3)], "file_id string, path string, title string, creator string, created string, modified string, page_count int")
    assert pdf.document_metadata(info).first().title == "b.pdf"
