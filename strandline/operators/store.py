"""Table changes as pure functions from the old table to the new, and a store whose changes land together.

Files on a cluster can't be changed in place: changed rows are written beside the
old ones, and one file of the commit log then names the folders of all tables. A
lost job leaves rows that no commit names; readers keep the commit they began with.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.commits import Busy, CommitLog, Conflict, LeaseLost, State
from strandline.schemas import KEYS, PARTITIONED, TABLES

T = TypeVar("T")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` take the place of those with the same key; the source has each key once."""
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def typed(chunks: DataFrame) -> DataFrame:
    """Chunks with ``text`` where the content type is empty or missing."""
    return chunks.withColumn("content_type", F.coalesce(F.nullif("content_type", F.lit("")), F.lit("text")))


def embedding_rows(chunks_with_vector: DataFrame) -> DataFrame:
    """The embeddings of chunks that have a vector."""
    return chunks_with_vector.filter("vector is not null").select("chunk_id", "vector")


def new_cache_rows(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries whose hash isn't cached yet, one for each hash."""
    fresh = entries.filter("vector is not null").groupBy("content_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return fresh.join(cache.select("content_hash"), "content_hash", "left_anti")


def delete_files(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files in ``gone`` (file_id), their chunks and their embeddings."""
    lost = chunks.join(gone.select("file_id"), "file_id", "left_semi").select("chunk_id")
    return files.join(gone.select("file_id"), "file_id", "left_anti"), chunks.join(gone.select("file_id"), "file_id", "left_anti"), embeddings.join(lost, "chunk_id", "left_anti")


def probe_cache(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` (with content_hash) and the cached vector of each; equal contents all get it."""
    return chunks.join(cache.select("content_hash", "vector"), "content_hash", "left")


def columns_of(table: str) -> list[str]:
    return [column.split()[0] for column in TABLES[table].split(", ")]


class Snapshot:
    """The tables as one commit names them."""

    def __init__(self, store: Store, state: State):
        self.store, self.state = store, state

    def read(self, table: str) -> DataFrame:
        folders = self.state.tables.get(table, [])
        if not folders:
            return self.store.spark.createDataFrame([], TABLES[table])
        rows = self.store.spark.read.schema(TABLES[table])
        if table in PARTITIONED:
            rows = rows.option("basePath", f"{self.store.root}/{table}")
        return rows.parquet(*[f"{self.store.root}/{folder}" for folder in folders]).select(*columns_of(table))

    def get_metadata(self, key: str) -> str | None:
        row = self.read("metadata").filter(F.col("key") == key).select("value").first()
        return row and row[0]


class Transaction(Snapshot):
    """Changes of several tables; reads see them, others see none or all, from ``commit`` on.

    ``append`` is for rows whose keys the caller knows to be new.
    """

    def __init__(self, store: Store, state: State, fence: int | None):
        super().__init__(store, State(state.version, dict(state.tables), state.lease))
        self.base, self.fence = state, fence

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/run={uuid.uuid4().hex}"
        rows, by = rows.select(*columns_of(table)), PARTITIONED.get(table, [])
        rows = rows.hint("rebalance", *by) if by else rows
        rows.write.partitionBy(*by).parquet(f"{self.store.root}/{folder}")
        return folder

    def append(self, table: str, rows: DataFrame) -> None:
        self.state.tables[table] = [*self.state.tables.get(table, []), self._write(table, rows)]

    def replace(self, table: str, rows: DataFrame) -> None:
        self.state.tables[table] = [self._write(table, rows)]

    def upsert(self, table: str, rows: DataFrame) -> None:
        """A row's key is there once, also if ``rows`` has it twice: a guard, as files can't have unique keys."""
        rows = typed(rows) if table == "chunks" else rows
        self.replace(table, upsert(self.read(table), rows.dropDuplicates([KEYS[table]]), KEYS[table]))

    def delete_files(self, gone: DataFrame) -> None:
        """Files, their chunks and embeddings, and these in the approximate index; gone (file_id) is read several times."""
        lost = self.read("chunks").join(gone.select("file_id"), "file_id", "left_semi").select("chunk_id")
        listed = self.read("lists").join(lost, "chunk_id", "left_anti") if self.state.tables.get("lists") else None
        files, chunks, embeddings = delete_files(self.read("files"), self.read("chunks"), self.read("embeddings"), gone)
        for table, rows in (("embeddings", embeddings), ("chunks", chunks), ("files", files), ("lists", listed)):
            if rows is not None:
                self.replace(table, rows)

    def clear(self, *tables: str) -> None:
        """Empty the index, or ``tables``; its cache and metadata stay."""
        for table in tables or ("embeddings", "chunks", "files", "lists", "centers"):
            self.state.tables[table] = []

    def drop(self) -> None:
        self.clear(*TABLES)

    def set_metadata(self, **values: str) -> None:
        self.upsert("metadata", self.store.spark.createDataFrame(list(values.items()), TABLES["metadata"]))

    def changed(self) -> dict[str, list[str]]:
        return {t: f for t, f in self.state.tables.items() if f != self.base.tables.get(t, [])}


class Store:
    """An index as a folder of tables and a commit log."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log", clock)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.log.newest())

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def begin(self, fence: int | None = None) -> Transaction:
        return Transaction(self, self.log.newest(), fence)

    def commit(self, changes: Transaction) -> int:
        """Land the changes; a table that others changed meanwhile is a Conflict, other tables' changes stay beside."""
        wanted = changes.changed()
        while True:
            now = self.log.newest()
            self.log.may_write(now, changes.fence)
            moved = [t for t in wanted if now.tables.get(t, []) != changes.base.tables.get(t, [])]
            if moved:
                raise Conflict(f"changed meanwhile: {', '.join(sorted(moved))}")
            if not wanted:
                return now.version
            if self.log.claim(State(now.version + 1, now.tables | wanted, now.lease)):
                return now.version + 1

    def run(self, work: Callable[[Transaction], T], fence: int | None = None, attempts: int = 5) -> T:
        """``work`` and its commit; done again from the newest state where others came first."""
        for attempt in range(attempts):
            changes = self.begin(fence)
            out = work(changes)
            try:
                self.commit(changes)
                return out
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def append(self, table: str, rows: DataFrame) -> None:
        self.run(lambda t: t.append(table, rows))

    def replace(self, table: str, rows: DataFrame) -> None:
        self.run(lambda t: t.replace(table, rows))

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.run(lambda t: t.upsert(table, rows))

    def delete_files(self, gone: DataFrame) -> None:
        self.run(lambda t: t.delete_files(gone))

    def clear(self) -> None:
        self.run(lambda t: t.clear())

    def drop(self) -> None:
        self.run(lambda t: t.drop())

    def set_metadata(self, key: str, value: str) -> None:
        self.run(lambda t: t.set_metadata(**{key: value}))

    def get_metadata(self, key: str) -> str | None:
        return self.snapshot().get_metadata(key)

    def compact(self, most: int = 32, fence: int | None = None) -> None:
        """Tables of more than ``most`` folders become one folder each."""
        self.run(lambda t: [t.replace(table, t.read(table)) for table, folders in dict(t.state.tables).items() if len(folders) > most] and None, fence)

    def vacuum(self, keep: int = 10) -> int:
        """Delete what none of the last ``keep`` commits names: folders of lost runs too, so no other writer may be at work. Returns how many folders went."""
        lease = self.log.newest().lease
        if lease and lease["expires"] > self.log.clock():
            raise Busy("a writer is at work")
        named = {folder for state in self.log.last(keep) for folders in state.tables.values() for folder in folders}
        self.log.forget(keep)
        gone = [f"{table}/{name}" for table in TABLES for name in self.log.names(f"{self.root}/{table}") if f"{table}/{name}" not in named]
        for folder in gone:
            self.log.remove(f"{self.root}/{folder}")
        return len(gone)


__all__ = ["Busy", "Conflict", "LeaseLost", "Snapshot", "Store", "Transaction"]
