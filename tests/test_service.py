
import base64
import time

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import embedding, provider, search
from strandline.plans import service
from strandline.plans.engine import Index
from strandline.sources import pdf


def test_search_arguments():
    parse = lambda line, **k: service.parse_search(line.split(), **k)
    assert parse("hello world --images-only --top 15") == service.SearchArguments("hello world", 15, "image")
    assert parse("--text-only -t 3 a --strategy hybrid b") == service.SearchArguments("a b", 3, "text", "hybrid")
    assert parse("a --other b").query == "a --other b" and parse("a --other b", keep_unknown=False).query == "a b"
    with pytest.raises(ValueError, match="exclude"):
        parse("a --text-only --images-only")
    assert set(service.TOOL_SCHEMAS) == set(Index.TOOLS)


def test_result_cache():
    now, found = [0.0], []
    cache = service.ResultCache(clock=lambda: now[0])
    find = lambda: found.append(1) or [len(found)]
    assert cache.get("/a", ("q",), find) == cache.get("/a", ("q",), find) == [1]
    now[0] = 301
    assert cache.get("/a", ("q",), find) == [2]
    cache.invalidate("/a")
    assert cache.get("/a", ("q",), find) == [3]


def test_retries():
    waits, answers = [], [TimeoutError(), provider.Refused(429), provider.Refused(500), "ok"]

    def call():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert provider.with_retries(call, waits.append)() == "ok" and waits == [1, 60, 90]
    answers[:] = [provider.Refused(400)]
    with pytest.raises(provider.Refused):
        provider.with_retries(call, waits.append)()
    assert [len(c) for c in provider.calls(["x"] * 2000)] == [950, 950, 100] and list(provider.calls(["x" * 100_000])) == []


def test_remote_functions(spark):
    embed = provider.remote_embedder(lambda texts: [[float(len(t))] for t in texts])
    df = spark.createDataFrame([("ab",), (None,), ("c" * 100_000,)], "t string")
    assert sorted((r[0] or [-1.0]) for r in df.select(embed(F.col("t"))).collect()) == [[-1.0], [0.0], [2.0]]
    score = provider.remote_scorer(lambda query, texts: [None if "b" in t else float(len(t)) for t in texts])
    hits = spark.createDataFrame([("1", "aaa"), ("2", "b"), ("3", "a")], "chunk_id string, content string")
    assert [r.chunk_id for r in search.rerank(hits, "q", score=score).collect()] == ["1", "3"]


def test_pdf_needs_a_reader(spark):
    pages = spark.createDataFrame([], "file_id string, page_number int, content binary")
    with pytest.raises(pdf.PdfUnavailable):
        pdf.render_pages(pages)
    assert pdf.render_pages(pages, lambda data, page: "x").count() == 0


def test_progress_never_waits_for_a_reader():
    now = [0.0]
    progress = service.Progress(most=3, every=60, clock=lambda: now[0])
    for n in range(5):
        progress.publish(n=n)
    assert [e["n"] for e in progress.read()] == [2, 3, 4] and progress.dropped == 2 and progress.read() == []
    with progress.phase("read", 8, lambda: 4):
        now[0] += 2
    assert [(e["done"], e["rate"], e["seconds_left"]) for e in progress.read()] == [(0, 0.0, None), (8, 4.0, 0.0)]
    with pytest.raises(ValueError), progress.phase("lost", 8, lambda: 0):
        raise ValueError
    assert [e["done"] for e in progress.read()] == [0]


def test_progress_of_an_update(spark, tmp_path, monkeypatch):
    from strandline.sources import folder

    monkeypatch.setattr(folder, "_TASK_FILES", 5)
    source = tmp_path / "many"
    source.mkdir()
    for i in range(40):
        (source / f"{i}.txt").write_text(f"text {i}")
    progress = service.Progress(most=1000, every=0.01)
    Index(spark, str(source), str(tmp_path / "store"), dimension=8, progress=progress).update()
    events = progress.read()
    for phase in ("read", "chunk", "embed"):
        done = [e["done"] for e in events if e["phase"] == phase]
        assert done == sorted(done) and done[0] == 0 and done[-1] == 40 and all(e["total"] == 40 for e in events if e["phase"] == phase)
    assert len([e for e in events if e["phase"] == "read"]) > 2
    assert Index(spark, str(source), str(tmp_path / "store"), dimension=8, progress=progress).update()["new"] == 0 and progress.read() == []


def test_multimodal_embedder(spark, tmp_path):
    """Answers come in order whatever the calls take; a short answer leaves its own call's inputs without vectors."""
    def request(inputs):
        time.sleep(0.05 if len(inputs) % 2 else 0.0)
        if any("short" in i.get("text", "") for i in inputs):
            return [[0.0, 0.0]]
        return [[float(len(i.get("text", ""))), float(i["type"] == "image_base64")] for i in inputs]

    embed = provider.MultimodalEmbedder(request, at_once=3)
    texts = ["x" * n for n in range(1, 3000, 3)] + ["short " * 15_000, "short two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in df.select("i", embed(F.col("t")).alias("v")).collect()}
    assert all(got[i][0] == len(t) for i, t in enumerate(texts) if got[i] is not None)
    lost = [i for i in got if got[i] is None]
    assert {1000, 1001} <= set(lost) and len(lost) < 700 and got[0] is not None

    def png(width, height):
        return base64.b64encode(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\0" * 100)

    rows = [("a", "caption", "image", png(600, 400)), ("b", "caption", "image", png(10, 10)), ("c", "caption", "image", b"!!"), ("d", "words", "text", None), ("e", "", "text", None), ("f", "caption", "image", png(600, 400))]
    chunks = spark.createDataFrame([(*r[:3], bytearray(r[3]) if r[3] else None) for r in rows], "chunk_id string, content string, content_type string, image_data binary")
    empty = spark.createDataFrame([], schemas.CACHE)
    found, fresh = embedding.resolve(chunks, empty, embed)
    assert {r.chunk_id: r.vector for r in found.collect()} == {"a": [0.0, 1.0], "f": [0.0, 1.0], "b": None, "c": None, "d": [5.0, 0.0], "e": None}
    assert fresh.count() == 2
    plain, _ = embedding.resolve(chunks, empty, embedding.offline(2))
    assert {r.chunk_id for r in plain.filter("vector is null").collect()} == {"e"}
