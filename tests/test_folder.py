import hashlib
import os

import pytest
from pyspark.sql import functions as F

from strandline.plans.engine import Index
from strandline.sources import folder as source


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ("a.md", "b.PNG", "c.exe", ".hidden.md", "docs/d.txt", "docs/deep/er/e.go", "node_modules/m.js", "docs/vendor/v.go", ".git/x.md", "docs/.cache/y.md", "wide/f0.md", "wide/g/f1.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    (root / "loop").symlink_to(root)
    (root / "gone.md").symlink_to(root / "nothing")
    return root


KEPT = ["a.md", "b.PNG", "docs/d.txt", "docs/deep/er/e.go", "wide/f0.md", "wide/g/f1.md"]


def test_listing(spark, tree):
    rows = {r.path: r for r in source.scan(spark, str(tree)).collect()}
    assert sorted(rows) == sorted(str(tree / name) for name in KEPT)
    row = rows[str(tree / "docs/d.txt")]
    assert (row.size, row.file_type) == (len("text of docs/d.txt"), "txt")
    assert abs(row.modified_at.timestamp() - os.stat(tree / "docs/d.txt").st_mtime) < 24 * 3600
    assert [r.path for r in source.scan(spark, f"file://{tree}").orderBy("path").collect()] == sorted(rows)
    assert source.scan(spark, str(tree / ".git")).count() == source.scan(spark, str(tree / "node_modules")).count() == 0
    assert source.scan(spark, str(tree / "nowhere")).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 100])
def test_pruned_folders_are_never_listed(tree, monkeypatch, parts):
    monkeypatch.setattr(source, "_PARTS", parts)
    asked, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: asked.append(str(path)) or scandir(path))
    reader = source.FolderReader(str(tree))
    found = [path for part in reader.partitions() for batch in reader.read(part) for path in batch.column(0).to_pylist()]
    assert sorted(found) == sorted(str(tree / name) for name in KEPT)
    assert not [path for path in asked if "node_modules" in path or "vendor" in path or "/." in path or "loop" in path]


def test_other_file_systems(tree):
    """The same listing through an Arrow file system, as remote stores have it."""
    from pyarrow import fs

    system = fs.SubTreeFileSystem(str(tree), fs.LocalFileSystem())
    names = {e.name: e for e in source.entries(system, "docs")}
    assert names["deep"].is_dir and names["d.txt"].size == len("text of docs/d.txt") and names["d.txt"].path == "docs/d.txt"
    assert b"".join(source._stream(system, "docs/d.txt")) == b"text of docs/d.txt"
    assert source.entries(system, "nothing") == []


def test_contents_and_hashes_come_from_one_read(spark, tree, monkeypatch):
    files = source.scan(spark, str(tree))
    wanted = F.col("path").endswith("md")
    rows = {os.path.relpath(r.path, tree): r for r in source.contents(files, wanted).collect()}
    assert sorted(rows) == KEPT
    for name, r in rows.items():
        data = f"text of {name}".encode()
        assert r.file_hash == hashlib.sha256(data).hexdigest() and r.content == (data if name.endswith("md") else None)
    lost = spark.createDataFrame([(str(tree / "none.md"), 5)], "path string, size long")
    assert [(r.content, r.file_hash) for r in source.contents(lost).collect()] == [(None, None)]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Hashed and recorded though no value could hold it; a task holds one block of it."""
    root = tmp_path / "big"
    root.mkdir()
    with open(root / "huge.txt", "wb") as huge:
        huge.truncate(3 << 30)
    (root / "small.txt").write_text("small")
    index = Index(spark, str(root), str(tmp_path / "store"), dimension=8)
    assert index.update()["new"] == 2
    digest, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range((3 << 30) >> 24):
        digest.update(block)
    row = index.store.read("files").filter(F.col("size") > 5).first()
    assert (row.size, row.file_hash) == (3 << 30, digest.hexdigest())
    assert index.store.read("chunks").count() == 1
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0}
    assert index.read_file(str(root / "huge.txt")).endswith(f"[truncated — file is {3 << 30} bytes, showing first 51200 bytes]")


def test_a_file_that_cannot_be_read_now(spark, tmp_path, monkeypatch):
    """It is neither changed nor deleted, and is taken up when it can be read again."""
    root = tmp_path / "some"
    root.mkdir()
    (root / "a.txt").write_text("one")
    index = Index(spark, str(root), str(tmp_path / "store"), dimension=8)
    index.update()
    os.utime(root / "a.txt", (1, 1))
    contents = source.contents
    monkeypatch.setattr(source, "contents", lambda *a: contents(*a).withColumns({"content": F.lit(None).cast("binary"), "file_hash": F.lit(None).cast("string")}))
    assert index.update() == {"new": 0, "modified": 0, "deleted": 0} and index.store.read("files").count() == 1
    monkeypatch.undo()
    (root / "a.txt").write_text("two")
    assert index.update()["modified"] == 1
