"""Approximate nearest vectors: lists of vectors around trained centers.

The exact search stays the default. Centers are fitted by k-means over at most
SAMPLE vectors at length one; every vector is dealt to the list of its nearest
center. Lists are written apart from each other, so a search that looks into a few
lists reads these alone; distances inside them are exact. Vectors that come later
go to the lists of the present centers until these are trained again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.functions import vectors
from strandline.schemas import CENTERS

#: Vectors that centers are fitted to at most, and lists at most; both bound what one task and the driver hold.
SAMPLE, MOST_LISTS = 200_000, 4096
#: So many vectors are looked for to choose how many lists a search looks into, so that this share of the so many nearest is found.
ASKED, NEAREST, FOUND = 128, 10, 0.95
#: Vectors that are dealt together.
_TOGETHER = 1024
_ROUNDS = 10
#: Of many queries: queries dealt together; values of vectors or queries in a block at most, and vectors at least; closenesses held at once.
_ASKED_TOGETHER, _BLOCK_VALUES, _LEAST, _HELD = 256, 1 << 21, 256, 1 << 21


def list_count(total: int) -> int:
    return max(1, min(MOST_LISTS, math.isqrt(total)))


def train(embeddings: DataFrame, total: int | None = None, seed: int = 1) -> DataFrame:
    """The centers (list, center) for ``embeddings`` (vector); of few vectors there is one list, whose center has no values."""
    total = embeddings.count() if total is None else total
    some = embeddings.filter("vector is not null").select("vector")
    some = some if total <= SAMPLE else some.sample(SAMPLE / total, seed)
    # one file of few row groups would be one task in all rounds
    some = some.repartition(embeddings.sparkSession.sparkContext.defaultParallelism)
    rows = some.select(array_to_vector(vectors.unit("vector")).alias("features")).persist()
    try:
        if list_count(total) == 1 or rows.isEmpty():
            found = [[]]
        else:
            found = [list(map(float, c)) for c in KMeans(k=list_count(total), maxIter=_ROUNDS, seed=seed, solver="block").fit(rows).clusterCenters()]
    finally:
        rows.unpersist()
    return embeddings.sparkSession.createDataFrame(list(enumerate(found)), CENTERS)


def _matrix(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """List numbers and centers at length one; at most MOST_LISTS rows."""
    rows = sorted(centers.collect())
    matrix = np.array([r.center for r in rows], np.float64).reshape(len(rows), -1)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.array([r.list for r in rows], np.int32), np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def deal(embeddings: DataFrame, centers: DataFrame) -> DataFrame:
    """chunk_id, vector and list of each row of ``embeddings`` that has a vector; no shuffle."""
    told = embeddings.sparkSession.sparkContext.broadcast(_matrix(centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, matrix = told.value
        for batch in batches:
            for begin in range(0, batch.num_rows, _TOGETHER):
                some = batch.slice(begin, _TOGETHER)
                values = np.nan_to_num(_values(some.column(1)))
                nearest_center = (values @ matrix.T).argmax(axis=1) if matrix.shape[1] else np.zeros(some.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(numbers[nearest_center], pa.int32())], names=["chunk_id", "vector", "list"])

    rows = embeddings.select("chunk_id", "vector").filter("vector is not null")
    return rows.mapInArrow(run, rows.withColumn("list", F.lit(0)).schema)


def _values(lists: pa.Array) -> np.ndarray:
    """The rows of vectors of one length as doubles; a null value is not a number."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _order(values: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each row of ``values`` the centers' places, nearest first."""
    if not matrix.shape[1]:
        return np.zeros((len(values), 1), np.int64)
    return np.argsort(-(values @ matrix.T), axis=1, kind="stable")


def calibrate(dealt: DataFrame, centers: DataFrame, asked: int = ASKED, k: int = NEAREST, found: float = FOUND) -> int:
    """How many lists hold ``found`` of the k nearest vectors, as ``asked`` vectors see it, picked by a hash of their ids.

    Each task holds these few against its vectors in blocks and passes on its k nearest of each.
    """
    numbers, matrix = _matrix(centers)
    picked = [r.vector for r in dealt.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vector").limit(asked).collect()]
    if not picked or len(numbers) == 1:
        return 1
    queries = np.nan_to_num(np.array(picked, np.float64))
    told = dealt.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, lists = np.full((len(told.value), 0), 0.0), np.full((len(told.value), 0), 0, np.int32)
        for batch in batches:
            for begin in range(0, batch.num_rows, _TOGETHER):
                some = batch.slice(begin, _TOGETHER)
                values = np.nan_to_num(_values(some.column(0)))
                size = np.linalg.norm(values, axis=1)
                close = np.divide(told.value @ values.T, size, out=np.zeros((len(told.value), some.num_rows)), where=size > 0)
                best = np.concatenate([best, close], axis=1)
                lists = np.concatenate([lists, np.broadcast_to(some.column(1).to_numpy(), close.shape)], axis=1)
                keep = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, lists = np.take_along_axis(best, keep, 1), np.take_along_axis(lists, keep, 1)
        if best.shape[1]:
            query = np.repeat(np.arange(len(best)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best.ravel()), pa.array(lists.ravel())], names=["query", "close", "list"])

    hits = dealt.select("vector", "list").mapInArrow(run, "query long, close double, list int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("close")))
    rows = hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "list").collect()  # asked x k
    order = _order(queries, matrix)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    at = {number: i for i, number in enumerate(numbers.tolist())}
    needed = sorted(int(place[r.query, at[r.list]]) + 1 for r in rows)
    return needed[min(math.ceil(found * len(needed)), len(needed)) - 1]


def nearest(dealt: DataFrame, centers: DataFrame, query: Column, k: int, probes: int) -> DataFrame:
    """chunk_id and distance of the k nearest vectors in the ``probes`` lists nearest to the query; the lists' filter prunes the scan."""
    ranked = centers.select("list", vectors.cosine_distance("center", query).alias("distance")).orderBy(F.asc_nulls_last("distance"), "list")
    wanted = [r.list for r in ranked.limit(probes).collect()]
    found = dealt.filter(F.col("list").isin(wanted))
    return found.select("chunk_id", vectors.cosine_distance("vector", query).alias("distance")).orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(k)


def _blocks(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Of each list the first of its blocks and their number; a list of more than ``most`` vectors has blocks of its own, small ones share one."""
    found, begun, room = {}, 0, 0
    for number, size in sorted(sizes.items()):
        if size > room:
            found[number] = begun, -(-size // most)
            begun += found[number][1]
            room = most - size
        else:
            found[number] = begun - 1, 1
            room -= size
    return found


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first value to the last, as a plain loop does, so that equal rows have equal ones."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _kind(lists: pa.Array, size: np.ndarray) -> np.ndarray:
    """0 for a plain vector, 1 without length, 2 with a value that is no finite number, 3 with a null; of a pair the larger one counts."""
    null = lists.flatten().is_null().to_numpy(zero_copy_only=False).reshape(len(lists), -1).any(axis=1)
    return np.select([null, ~np.isfinite(size), size == 0], [3, 2, 1], 0)


def _nearest_in_block(vectors: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """query_id, chunk_id and distance of the k nearest of ``vectors`` (block, part, list, chunk_id, vector) in the lists of each of
    ``asked`` (query_id, wanted, block, lists, part).

    A product of matrices, right but for its rounding, rules out most pairs; what is within
    the rounding of the k-th is reckoned value by value. Distances are numbers, then not numbers, then null.
    """
    names = ["query_id", "chunk_id", "distance"]
    if not len(vectors) or not len(asked):
        return pa.table([asked["query_id"].slice(0, 0), vectors["chunk_id"].slice(0, 0), pa.array([], pa.float64())], names=names)
    vectors = vectors.take(pc.sort_indices(vectors, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
    lists, values, queries = vectors["list"].to_numpy(), _values(vectors["vector"].combine_chunks()), _values(asked["wanted"].combine_chunks())
    size, query_size = _dots(values, values), _dots(queries, queries)
    kind, query_kind = _kind(vectors["vector"].combine_chunks(), size), _kind(asked["wanted"].combine_chunks(), query_size)
    if len(values) > k:  # of equal vectors only the k first can be among the nearest
        same = np.column_stack([values, lists, kind])
        same = np.unique(same.view(np.dtype((np.void, same.itemsize * same.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        kept = np.sort(order[place < k])
        vectors, lists, values, size, kind = vectors.take(pa.array(kept)), lists[kept], values[kept], size[kept], kind[kept]
    there, code = np.unique(lists, return_inverse=True)
    told = asked["lists"].combine_chunks()
    row, number = np.repeat(np.arange(len(asked)), told.value_lengths().to_numpy()), told.flatten().to_numpy()
    at = np.minimum(np.searchsorted(there, number), len(there) - 1)
    wanted = np.zeros((len(asked), len(there)), bool)
    wanted[row[there[at] == number], at[there[at] == number]] = True

    unit = np.divide(values, np.sqrt(size)[:, None], out=np.zeros_like(values), where=(kind == 0)[:, None])
    query_unit = np.divide(queries, np.sqrt(query_size)[:, None], out=np.zeros_like(queries), where=(query_kind == 0)[:, None])
    rounding = 8 * (values.shape[1] + 8) * np.finfo(np.float64).eps
    found_query, found_vector, found_distance = [], [], []
    by_list = np.argsort(wanted.argmax(axis=1), kind="stable")  # queries of the same lists together
    step = max(1, _HELD // len(values))
    for begin in range(0, len(by_list), step):
        some = by_list[begin : begin + step]
        columns = np.flatnonzero(wanted[some].any(axis=0)[code])
        if not len(columns):
            continue
        close = query_unit[some] @ unit[columns].T
        if kind[columns].any() or query_kind[some].any():
            worst = np.maximum.outer(query_kind[some], kind[columns])
            close = np.where(worst == 0, close, np.array([0.0, -3.0, -2.0, -3.0])[worst])
        close[~wanted[some][:, code[columns]]] = -np.inf
        last = np.partition(close, -k, axis=1)[:, -k] if len(columns) > k else np.full(len(some), -np.inf)
        picked = close >= (last - rounding)[:, None]
        for i in np.flatnonzero(last < -1.5):  # too few with a distance: all of them, then others by id
            picked[i] = False
            picked[i, np.argsort(-close[i], kind="stable")[:k]] = True
        picked &= close > -np.inf
        q, v = np.nonzero(picked)
        q, v = some[q], columns[v]
        worst = np.maximum(query_kind[q], kind[v])
        plain = worst == 0
        distance = np.full(len(q), np.nan)
        distance[plain] = 1 - np.clip(_dots(queries[q[plain]], values[v[plain]]) / np.sqrt(query_size[q[plain]] * size[v[plain]]), -1, 1)
        level = np.array([0, 2, 1, 2])[worst]
        order = np.lexsort((v, distance, level, q))
        q, v, distance, level = q[order], v[order], distance[order], level[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        found_query.append(q[best])
        found_vector.append(v[best])
        found_distance.append(pa.array(distance[best], mask=level[best] == 2))
    if not found_query:
        return _nearest_in_block(vectors.slice(0, 0), asked, k)
    take = lambda table, name, places: table[name].take(pa.array(np.concatenate(places)))
    return pa.table([take(asked, "query_id", found_query), take(vectors, "chunk_id", found_vector), pa.chunked_array(found_distance)], names=names)


def nearest_of_many(dealt: DataFrame, centers: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, chunk_id, distance and rank (from 1) for each of ``queries`` (query_id, vector).

    Lists are dealt to blocks of bounded size, queries to the blocks of the lists
    they look into. A block and a part of its queries meet in one task, which passes
    on each query's k nearest; no row is made for a pair.
    """
    spark = dealt.sparkSession
    numbers, matrix = _matrix(centers)
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    most = max(_LEAST, min(_BLOCK_VALUES // max(matrix.shape[1], 64), -(-sum(sizes.values()) // (4 * spark.sparkContext.defaultParallelism))))
    blocks = _blocks(sizes, most)
    parts = max(1, -(-queries.count() * max(matrix.shape[1], 64) // _BLOCK_VALUES))
    first = np.array([blocks.get(n, (0, 0))[0] for n in numbers.tolist()], np.int64)
    count = np.array([blocks.get(n, (0, 0))[1] for n in numbers.tolist()], np.int64)
    told = spark.sparkContext.broadcast((numbers, matrix, first, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, matrix, first, count = told.value
        for batch in batches:
            for begin in range(0, batch.num_rows, _ASKED_TOGETHER):
                some = batch.slice(begin, _ASKED_TOGETHER)
                near = _order(np.nan_to_num(_values(some.column(1))), matrix)[:, :probes]
                row, at = np.repeat(np.arange(some.num_rows), near.shape[1]), near.ravel()
                times = count[at]
                row, at, begins = np.repeat(row, times), np.repeat(at, times), np.repeat(np.cumsum(times) - times, times)
                block = first[at] + np.arange(len(at)) - begins
                order = np.lexsort((block, row))
                row, at, block = row[order], at[order], block[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])][: len(row)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(numbers[at], pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row[new])).columns, pa.array(block[new], pa.int64()), lists], names=["query_id", "wanted", "block", "lists"])

    asked = queries.select("query_id", F.col("vector").alias("wanted")).filter("wanted is not null")
    asked = asked.mapInArrow(run, asked.withColumns({"block": F.lit(0).cast("long"), "lists": F.array(F.lit(0))}).schema)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    placed = spark.createDataFrame([(n, b, c) for n, (b, c) in blocks.items()], "list int, first long, blocks long")
    placed = dealt.join(F.broadcast(placed), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("chunk_id"), "blocks"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select("block", "part", "list", "chunk_id", "vector")
    tasks = parts * max((b + c for b, c in blocks.values()), default=1)
    schema = StructType([queries.schema["query_id"], dealt.schema["chunk_id"], StructField("distance", DoubleType())])

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        return _nearest_in_block(vectors, asked, k)

    near = placed.repartition(tasks, "block", "part").groupBy("block", "part").cogroup(asked.repartition(tasks, "block", "part").groupBy("block", "part")).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of ``exact`` (query_id, chunk_id) that are in ``found``."""
    both = exact.join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
