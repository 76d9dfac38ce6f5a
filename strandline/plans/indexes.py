"""All indexes under one root: what there is, and a search over several of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators import embedding, metadata, search, store
from strandline.workspace import file_system

INFO = "index_name string, folder_path string, chunks long, last_modified timestamp, error string"
HITS = "index_name string, chunk_id string, file_path string, content string, content_type string, distance double, error string"
#: Indexes that are looked into at the same time.
AT_ONCE = 8


def names(spark: SparkSession, root: str) -> list[str]:
    """Folders under ``root`` with a commit log."""
    system, place = file_system(spark, root)
    if not system.exists(place):
        return []
    found = sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())
    return [n for n in found if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/log"))]


def _of_each(spark: SparkSession, indexes: list[str], look: Callable[[str], list[tuple]], stub: Callable[[str, str], tuple]) -> list[tuple]:
    """The rows that ``look`` finds in each index; one that fails gives its stub, and the others go on."""

    def safe(name: str) -> list[tuple]:
        try:
            return look(name)
        except Exception as error:  # whatever is broken in it, the index stays visible
            return [stub(name, str(error).strip().splitlines()[0][:200])]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [row for rows in pool.map(inheritable_thread_target(spark)(safe), indexes) for row in rows]


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """A row for each index under ``root``: its folder and number of chunks, or why it can't be read."""
    root = root.rstrip("/")

    def look(name: str) -> list[tuple]:
        index = store.Store(spark, f"{root}/{name}").snapshot()
        if not index.state.version:
            raise ValueError("no commit")
        return [(name, index.get_metadata("folder_path") or name, index.read("chunks").count(), index.read("files").agg(F.max("indexed_at").cast("timestamp")).first()[0], None)]

    found = _of_each(spark, names(spark, root), look, lambda name, error: (name, name, None, None, error))
    return spark.createDataFrame(found, INFO)


def newest(spark: SparkSession, root: str, now: str) -> DataFrame:
    """``list_indexes`` newest first, with the bucket of their age and how long ago they changed."""
    found = metadata.newest_indexes(list_indexes(spark, root), F.lit(now[:10]))
    return found.withColumn("changed", paths.relative_time("last_modified", F.lit(now)))


def search_indexes(spark: SparkSession, root: str, query: str, k: int, embed: embedding.Embedder, dimension: int, strategy: str = "semantic", content_type: str = "", only: list[str] | None = None) -> DataFrame:
    """The k best hits of all indexes under ``root``, or of ``only`` some, nearest first.

    Each index gives its k best, so the merge sees k rows an index. One that can't be
    searched, or whose vectors are of another length, gives a row with its error, behind the hits.
    """
    root = root.rstrip("/")

    def look(name: str) -> list[tuple]:
        index = store.Store(spark, f"{root}/{name}").snapshot()
        if not index.state.version:
            raise ValueError("no commit")
        if (stored := index.get_metadata("dimension")) and int(stored) != dimension and strategy != "keyword":
            raise ValueError(f"the index holds vectors of {stored} values, the embedder makes {dimension}")
        found = search.search(index.read("chunks"), index.read("embeddings"), query, k, strategy, content_type, embed, dimension)
        return [(name, r.chunk_id, r.file_path, r.content, r.content_type, r.distance, None) for r in found.collect()]

    rows = _of_each(spark, only if only is not None else names(spark, root), look, lambda name, error: (name, None, None, None, None, None, error))
    hits = spark.createDataFrame([r for r in rows if r[-1] is None], HITS).orderBy(F.asc_nulls_last("distance"), "chunk_id", "index_name").limit(k)
    return hits.unionByName(spark.createDataFrame([r for r in rows if r[-1] is not None], HITS))
