import base64
import os
import threading
import time

import pytest

from strandline import workspace
from strandline.operators import embedding
from strandline.operators.store import Transaction
from strandline.plans import indexes
from strandline.plans.engine import Index
from strandline.sources import pdf
from strandline.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "project"
    (source / "docs").mkdir(parents=True)
    (source / ".git").mkdir()
    for name, body in {"README.md": "# Title about cats and pets", "main.go": "package main", "config.yaml": "a: 1", "docs/api.md": "The API describes dogs.", ".git/x.md": "hidden", "data.json": "{}"}.items():
        (source / name).write_text(body)
    return source


def test_index_search_update(spark, folder, tmp_path):
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    assert index.update() == {"new": 4, "modified": 0, "deleted": 0}
    assert index.call("search", query="cats", strategy="keyword").first().file_path.endswith("README.md")
    assert index.search("# Title about cats and pets", 1).first().distance == pytest.approx(0, abs=1e-6)
    assert index.search("dogs", 3, "hybrid").count() == 3
    (folder / "main.go").write_text("package other")
    (folder / "config.yaml").unlink()
    (folder / "new.txt").write_text("brand new")
    row = index.status().first()
    assert (row.total, row.pending_add, row.pending_update, row.pending_delete, row.chunks) == (4, 1, 1, 1, 4)
    assert index.update() == {"new": 1, "modified": 1, "deleted": 1}
    assert {r.file_name for r in index.find_files().collect()} == {"README.md", "api.md", "main.go", "new.txt"}
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0}
    assert index.get_file_chunks(str(folder / "main.go")).first().content == "package other"
    assert index.get_file_info(str(folder / "new.txt")).first().chunk_count == 1
    assert index.read_file(str(folder / "new.txt")) == "brand new"
    assert {(r.name, r.is_dir) for r in index.list_dir().collect()} == {("README.md", False), ("docs", True), ("main.go", False), ("new.txt", False)}
    with pytest.raises(ValueError, match="outside"):
        index.read_file("/etc/hosts.txt")
    with pytest.raises(ValueError, match="unknown"):
        index.call("nothing")


def test_pdf_by_a_given_reader(spark):
    files = spark.createDataFrame([("f", bytearray(b"one|two")), ("g", bytearray(b"broken"))], "file_id string, content binary")

    def reader(data):
        if data == b"broken":
            raise ValueError
        return data.decode().split("|")

    assert [(r.page_number, r.text) for r in pdf.read_pages(files, reader).collect()] == [(1, "one"), (2, "two")]


def test_streams(spark, folder, tmp_path):
    seen = []
    ingest.ingest_new_files(spark, str(folder), str(tmp_path / "ck"), lambda df, n: seen.extend(r.path for r in df.select("path").collect()), "*.md").awaitTermination()
    first = len(seen)
    (folder / "later.md").write_text("x")
    ingest.ingest_new_files(spark, str(folder), str(tmp_path / "ck"), lambda df, n: seen.extend(r.path for r in df.select("path").collect()), "*.md").awaitTermination()
    assert len(seen) == first + 1 and seen[-1].endswith("later.md")


def test_reads_stay_inside_and_whole(spark, folder, tmp_path):
    (tmp_path / "secret.txt").write_text("not for you")
    (folder / "blob.zip").write_bytes(b"PK")
    (folder / "long.txt").write_text("a" + "é" * 60_000)
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    for path in (f"{folder}/../secret.txt", f"{folder}/docs/../../secret.txt", f"{folder}x/a.md"):
        with pytest.raises(ValueError, match="outside"):
            index.read_file(path)
    with pytest.raises(ValueError, match="not read as text"):
        index.read_file(f"{folder}/blob.zip")
    head, notice = index.read_file(f"{folder}/docs/../long.txt").split("\n\n")
    assert head == "a" + "é" * 25_599 and notice == "[truncated — file is 120001 bytes, showing first 51200 bytes]"


def test_other_encodings_and_large_files(spark, folder, tmp_path):
    (folder / "latin.txt").write_bytes("caf\u00e9 ol\u00e9".encode("latin-1"))
    with open(folder / "large.txt", "wb") as large:
        large.truncate(51 * 1024 * 1024)
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    assert index.update()["new"] == 6
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0}
    assert index.get_file_chunks(str(folder / "latin.txt")).first().content == "caf\ufffd ol\ufffd"


def test_a_run_lost_anywhere_leaves_the_last_state(spark, folder, tmp_path, monkeypatch):
    """A run that ends before any of its writes shows readers nothing, and the next one doubles nothing."""
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    assert index.update()["new"] == 4
    (folder / "main.go").write_text("package other, longer")
    (folder / "config.yaml").unlink()
    (folder / "more.md").write_text("more of it")

    def contents():
        return {t: sorted(map(repr, index.store.read(t).drop("indexed_at", "created_at").collect())) for t in ("files", "chunks", "embeddings", "metadata")}

    before, write, commit = contents(), Transaction._write, index.store.commit
    for last in (0, 2, 4, 6, 99):  # the run's writes, then its commit
        calls = []

        def dies(self, *args):
            calls.append(1)
            if len(calls) > last:
                raise RuntimeError("lost")
            return write(self, *args)

        def dies_at_commit(changes):
            raise RuntimeError("lost")

        monkeypatch.setattr(Transaction, "_write", dies)
        monkeypatch.setattr(index.store, "commit", dies_at_commit if last == 99 else commit)
        with pytest.raises(RuntimeError, match="lost"):
            index.update()
        monkeypatch.undo()
        assert contents() == before
    index.update()
    for table, key in (("chunks", "chunk_id"), ("embeddings", "chunk_id"), ("files", "file_id")):
        rows = index.store.read(table)
        assert rows.count() == rows.select(key).distinct().count() == 4
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0}
    index.store.vacuum(1)
    assert all(len(index.store.log.names(f"{index.store.root}/{t}")) == len(f) for t, f in index.store.snapshot().state.tables.items())
    assert index.search("more of it", 1).first().file_path.endswith("more.md")


def test_nothing_stays_but_the_index(spark, folder, tmp_path):
    """Tables of a run go with it, and a run that finds no change writes nothing."""
    shared = workspace.shared_dir(spark) + "/strandline"
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    index.update()
    assert index.status().first().total == 4 and index.status_preview().count() == 0
    assert set(os.listdir(shared) if os.path.exists(shared) else []) <= before
    state = index.store.snapshot().state
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0} and index.store.snapshot().state == state


def test_other_embedder(spark, folder, tmp_path):
    Index(spark, str(folder), str(tmp_path / "store"), dimension=16).update()
    other = Index(spark, str(folder), str(tmp_path / "store"), dimension=8)
    with pytest.raises(ValueError, match="vectors of 16 values"):
        other.search("dogs")
    assert other.update()["new"] == 4 and other.search("dogs", 2).count() == 2


def test_links_and_case(spark, folder, tmp_path):
    secret = tmp_path / "secret.txt"
    secret.write_text("not for you")
    (folder / "link.txt").symlink_to(secret)
    upper = tmp_path / "PROJECT"
    upper.mkdir()
    (upper / "secret.txt").write_text("not for you either")
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    for path in (f"{folder}/link.txt", f"{upper}/secret.txt"):
        with pytest.raises(ValueError, match="outside"):
            index.read_file(path)


def test_approximate_search_of_an_index(spark, tmp_path):
    source = tmp_path / "texts"
    source.mkdir()
    for i in range(60):
        (source / f"{i:02}.txt").write_text(f"text number {i} of them")
    index = Index(spark, str(source), str(tmp_path / "store"), dimension=16, approximate=True)
    index.update()
    assert index.store.get_metadata("lists_trained") == "60" and index.store.get_metadata("lists_stale") == "false"
    for i in (3, 44):
        assert index.search(f"text number {i} of them", 3, approximate=True).first().file_path.endswith(f"/{i:02}.txt")
    plan = index.search("text number 3 of them", 3, approximate=True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "[list") or "list#" in plan.split("PartitionFilters")[1][:200]
    (source / "07.txt").write_text("changed and longer than before")
    (source / "08.txt").unlink()
    (source / "60.txt").write_text("a new one")
    index.update()
    found = index.store.read("lists")
    assert found.count() == found.select("chunk_id").distinct().count() == 60 == index.store.read("embeddings").count()
    assert index.search("a new one", 1, approximate=True).first().file_path.endswith("/60.txt")
    assert index.search("a new one", 5, "hybrid", approximate=True).count() >= 5


def test_small_changes_defer_training(spark, folder, tmp_path, monkeypatch):
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16, approximate=True)
    index.update()
    monkeypatch.setattr(embedding, "rebuild_policy", lambda trained, total: "skip" if trained == total else "defer")
    (folder / "late.md").write_text("late words")
    index.update()
    assert index.store.get_metadata("lists_stale") == "true" and index.store.read("lists").count() == 5
    assert index.search("late words", 1, approximate=True).first().file_path.endswith("late.md")
    assert index.rebuild_if_stale() and not index.rebuild_if_stale()
    assert index.store.get_metadata("lists_trained") == "5" and index.store.read("lists").count() == 5


def test_pdf_pages_images_and_pictures(spark, tmp_path):
    source = tmp_path / "papers"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"%PDF")
    rich = "plenty of words on this page about rivers and boats. " * 6

    def png(width, height):
        return base64.b64encode(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + width.to_bytes(4, "big") + height.to_bytes(4, "big")).decode()

    def reader(data):
        return [rich, "short", "torn"]

    def images(data):
        return [(page, "png", 600, 400, png(600, 400)) for page in (1, 2, 3)] + [(1, "png", 10, 10, png(10, 10))]

    def renderer(data, page):
        if page == 3:
            raise ValueError("torn page")
        return png(800, 900)

    def contents(mode, **helpers):
        index = Index(spark, str(source), str(tmp_path / f"{mode}{len(helpers)}"), dimension=8, pdf_reader=reader, **helpers)
        index.update(mode)
        rows = index.get_file_chunks(str(source / "a.pdf")).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        return [r.content for r in rows]

    inside = [f"Image from page {page} (600x400, png)" for page in (1, 2, 3)]
    assert contents("both", pdf_images=images, renderer=renderer) == [rich.strip(), inside[0], "Image from page 2 (800x900, png)", inside[2]]
    assert contents("text_pdfimages", pdf_images=images) == [rich.strip(), *inside]
    assert contents("text_images", pdf_images=images) == [rich.strip()]


def test_answers_chunks_and_files(spark, folder, tmp_path):
    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=16)
    index.update()
    told = index.answer("cats", strategy="keyword", caller="http")
    assert [(r.file_name, r.has_image, r.size) for r in told] == [("README.md", None, len("# Title about cats and pets"))]
    first = index.answer("cats", strategy="keyword")
    assert first[0].content == "# Title about cats and pets" and index.answer("cats", strategy="keyword") is first
    assert index.get_chunk(told[0].chunk_id).first().content == "# Title about cats and pets"
    assert [r.path.rsplit("/", 1)[-1] for r in index.all_files().collect()] == ["README.md", "config.yaml", "api.md", "main.go"]
    (folder / "more.md").write_text("cats again")
    index.update()
    assert len(index.answer("cats", strategy="keyword")) == 2
    listed = indexes.newest(spark, str(tmp_path / "store"), "2100-01-01 00:00:00").first()
    assert listed.folder_path == str(folder) and listed.chunks == 5 and listed.bucket == "Older"


def test_a_cancelled_update_never_lands(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    @F.udf("array<float>")
    def slowly(text):
        time.sleep(6)
        return [1.0]

    index = Index(spark, str(folder), str(tmp_path / "store"), dimension=1)
    index.__dict__["dimension"] = 1
    index.embed = lambda content: slowly(content)
    failed = []

    def run():
        try:
            index.update()
        except Exception as error:
            failed.append(error)

    writer = threading.Thread(target=run)
    writer.start()
    began = time.time()
    while not [e for e in index.progress.read(1) if e["phase"] == "chunk" and e["done"]] and time.time() - began < 120:
        pass
    time.sleep(1)
    index.cancel()
    writer.join(120)
    assert failed and index.store.read("files").count() == 0
    assert Index(spark, str(folder), str(tmp_path / "store"), dimension=16).update()["new"] == 4
