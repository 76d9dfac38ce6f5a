"""Folders of files: a partitioned listing, streamed hashes, contents, image headers."""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.functions import paths

#: Bytes that a value can hold: what is larger is hashed in a stream, without its content.
READ_LIMIT = 2**31 - 2**20
#: Bytes that are read at once; contents that go on together; bytes and files meant for one task.
_BLOCK, _TOGETHER, _TASK_BYTES, _TASK_FILES = 4 << 20, 64 << 20, 256 << 20, 2000
#: The listing is dealt out once so many directories are known.
_PARTS = 64


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    size: int
    modified: float


def file_system(root: str) -> tuple[arrow_fs.FileSystem | None, str]:
    """What reads ``root`` (None for local folders) and its path there."""
    if root.startswith("file:"):
        return None, "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return None, root
    return arrow_fs.FileSystem.from_uri(root)


def entries(system: arrow_fs.FileSystem | None, folder: str) -> list[Entry]:
    """What lies directly in ``folder``; links to directories are not followed, a folder that can't be read is empty."""
    out = []
    try:
        if system is None:
            with os.scandir(folder or "/") as found:
                for e in found:
                    try:
                        about = e.stat()
                        if not (e.is_symlink() and e.is_dir()):
                            out.append(Entry(posixpath.join(folder, e.name), e.name, e.is_dir(), about.st_size, about.st_mtime))
                    except OSError:
                        continue  # gone meanwhile, or a link to nothing
        else:
            for i in system.get_file_info(arrow_fs.FileSelector(folder)):
                out.append(Entry(i.path, i.base_name, i.type == arrow_fs.FileType.Directory, i.size or 0, i.mtime_ns / 1e9 if i.mtime_ns else 0.0))
    except (PermissionError, FileNotFoundError):
        pass
    return out


def _descended(name: str) -> bool:
    return not name.startswith(".") and name not in paths.PRUNED


def _listed(name: str) -> bool:
    return not name.startswith(".") and os.path.splitext(name)[1].lower().removeprefix(".") in paths.SUPPORTED_TYPES


@dataclass
class _Folders(InputPartition):
    folder: str
    deep: bool

    def __init__(self, folder: str, deep: bool):
        super().__init__(None)
        self.folder, self.deep = folder, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """Directories level by level until there are enough of them; hidden and pruned ones are never entered."""
        system, top = file_system(self.root)
        if not _descended(posixpath.basename(top.rstrip("/"))):
            return [_Folders("", False)]
        shallow, level = [], [top.rstrip("/")]
        while level and len(level) < _PARTS and len(shallow) < _PARTS:
            shallow += level
            level = [e.path for folder in level for e in entries(system, folder) if e.is_dir and _descended(e.name)]
        return [_Folders(f, False) for f in shallow] + [_Folders(f, True) for f in level]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.root)
        prefix = "" if system is None else self.root[: self.root.index("://") + 3]
        waiting = [partition.folder] if partition.folder else []
        while waiting:
            found = entries(system, waiting.pop())
            if partition.deep:
                waiting += [e.path for e in found if e.is_dir and _descended(e.name)]
            files = [e for e in found if not e.is_dir and _listed(e.name)]
            if files:
                times = [datetime.fromtimestamp(int(e.modified * 1000) / 1000, UTC).replace(tzinfo=None) for e in files]
                yield pa.RecordBatch.from_arrays([pa.array([prefix + e.path for e in files]), pa.array([e.size for e in files], pa.int64()), pa.array(times, pa.timestamp("us"))], names=["path", "size", "modified_at"])


class FolderSource(DataSource):
    """spark.read.format("strandline_folder").option("root", ...): path, size and modified_at (UTC) of the files that are read."""

    @classmethod
    def name(cls) -> str:
        return "strandline_folder"

    def schema(self) -> str:
        return "path string, size bigint, modified_at timestamp_ntz"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["root"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, file_type, size and modified_at of the files that are read; contents stay untouched.

    Hidden and pruned directories are not entered, hidden files and other types are
    left out; the rule also looks at the root's own name. Tasks list subtrees.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).option("root", root).load().withColumn("file_type", paths.file_type("path"))


def _stream(system: arrow_fs.FileSystem | None, path: str) -> Iterator[bytes]:
    with open(path, "rb") if system is None else system.open_input_stream(path) as source:
        while block := source.read(_BLOCK):
            yield block


def _opened(path: str, known: dict) -> tuple[arrow_fs.FileSystem | None, str]:
    if "://" not in path:
        return None, path
    scheme, rest = path.split("://", 1)
    if scheme not in known:
        known[scheme] = file_system(path)[0]
    return known[scheme], rest


def contents(files: DataFrame, wanted: Column | None = None, counted: Accumulator | None = None) -> DataFrame:
    """path, content and file_hash (sha256) of each of ``files`` (path, size): both come from one read, block by block.

    Content is null where ``wanted`` is false and beyond READ_LIMIT: such a file is
    hashed without being held, whatever its size. A file that can't be read has neither.
    ``counted`` rises by the files of each task that ended, for a display alone.
    """
    about = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    tasks = max(about.bytes // _TASK_BYTES, about.files // _TASK_FILES) + 1
    held = (F.col("size") <= READ_LIMIT) & (F.lit(True) if wanted is None else wanted)
    rows = files.select("path", F.coalesce(held, F.lit(False)).alias("held"))
    rows = rows.repartition(max(tasks, files.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, size = {}, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.string())], names=["path", "content", "file_hash"])

        for given in batches:
            for path, hold in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                digest, blocks = hashlib.sha256(), []
                try:
                    for block in _stream(*_opened(path, known)):
                        digest.update(block)
                        if hold:
                            blocks.append(block)
                    out.append((path, b"".join(blocks) if hold else None, digest.hexdigest()))
                except OSError:
                    out.append((path, None, None))
                size += len(out[-1][1] or b"")
                if counted is not None:
                    counted.add(1)
                if size >= _TOGETHER or len(out) >= _TASK_FILES:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, "path string, content binary, file_hash string")


def head(path: str, size: int) -> tuple[bytes, int]:
    """The first ``size`` bytes of a file, and how many it has."""
    system, place = file_system(path)
    if system is None:
        with open(place, "rb") as source:
            return source.read(size), os.fstat(source.fileno()).st_size
    with system.open_input_file(place) as source:
        return source.read(size), source.size()


def resolved(path: str) -> str:
    """The path without ``.``, ``..`` and, in local folders, links."""
    system, place = file_system(path)
    return os.path.realpath(place) if system is None else path[: path.index("://") + 3] + posixpath.normpath(place)


def decode_text(content: Column | str) -> Column:
    """The bytes as UTF-8; what is none becomes U+FFFD."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def _number(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """``size`` bytes from 1-based ``at`` as an unsigned number."""
    digits = [F.hex(F.substr(data, F.lit(at) + i if isinstance(at, int) else at + i, F.lit(1))) for i in range(size)]
    return F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("int")


def image_format(data: Column | str) -> Column:
    """jpeg, png or gif by the first bytes; null for anything else."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E47", "png").when(head == "47494638", "gif")


def image_size(data: Column | str) -> Column:
    """struct(width, height) from the header of a PNG or GIF, or a JPEG's frame; null if there is none."""
    d = F.col(data) if isinstance(data, str) else data
    kind = image_format(d)
    # the first start-of-frame segment that segments lead to from the start; its marker is C0 to CF without C4, C8 and CC
    frame = F.regexp_extract(F.hex(d), r"^FFD8(?:FF(?:E[0-9A-F]|DB|C4|DD|FE)[0-9A-F]{4}(?:[0-9A-F]{2})*?)*?FFC[0-35-79-BD-F][0-9A-F]{6}([0-9A-F]{8})", 1)
    number = lambda text: F.conv(text, 16, 10).cast("int")
    return (
        F.when((kind == "png") & (F.length(d) >= 24), F.struct(_number(d, 17, 4).alias("width"), _number(d, 21, 4).alias("height")))
        .when((kind == "gif") & (F.length(d) >= 10), F.struct(_number(d, 7, 2, True).alias("width"), _number(d, 9, 2, True).alias("height")))
        .when((kind == "jpeg") & (frame != ""), F.struct(number(F.substring(frame, 5, 4)).alias("width"), number(F.substring(frame, 1, 4)).alias("height")))
    )
