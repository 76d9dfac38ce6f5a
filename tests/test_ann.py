import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import vectors as vector_functions
from strandline.operators import ann, search


def rows_around(rng, middles, count, width, spread):
    return [(f"c{i:05}", [m + rng.gauss(0, spread) for m in middles[i % len(middles)]]) for i in range(count)]


@pytest.mark.parametrize("spread", [0.2, 3.0], ids=["clusters", "no clusters"])
def test_recall_is_what_was_asked_for(spark, spread):
    """Measured against all distances, for vectors that were not looked at when the number of lists was chosen."""
    rng = random.Random(12)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = spark.createDataFrame(rows_around(rng, middles, 2500, 16, spread), schemas.EMBEDDINGS).repartition(4).cache()
    centers = ann.train(vectors)
    dealt = ann.deal(vectors, centers).cache()
    assert dealt.count() == 2500 and 40 <= centers.count() <= 50
    probes = ann.calibrate(dealt, centers)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(rows_around(rng, middles, 60, 16, spread))], "query_id string, vector array<float>").cache()
    exact = ann.nearest_of_many(dealt, centers, queries, 10, centers.count()).cache()
    plain = {r.query_id: {x.chunk_id for x in search.nearest(vectors, F.array(*map(F.lit, r.vector)), 10).collect()} for r in queries.limit(3).collect()}
    for query, ids in plain.items():
        assert {r.chunk_id for r in exact.filter(F.col("query_id") == query).collect()} == ids
    assert ann.recall(ann.nearest_of_many(dealt, centers, queries, 10, probes), exact) >= 0.9
    if spread < 1:
        assert probes < 0.5 * centers.count()
    one = queries.first()
    got = [(r.chunk_id, round(r.distance, 6)) for r in ann.nearest(dealt, centers, F.array(*map(F.lit, one.vector)), 10, centers.count()).collect()]
    assert got == [(r.chunk_id, round(r.distance, 6)) for r in exact.filter(F.col("query_id") == one.query_id).orderBy("rank").collect()]


def test_small_and_odd_tables(spark):
    for rows in ([], [("a", None)], [("a", [0.0, 0.0])], [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), (None, [0.0, 1.0])]):
        vectors = spark.createDataFrame(rows, schemas.EMBEDDINGS)
        centers = ann.train(vectors)
        dealt = ann.deal(vectors, centers)
        kept = [r for r in rows if r[1] is not None]
        assert dealt.count() == len(kept) and 1 <= ann.calibrate(dealt, centers) <= max(centers.count(), 1)
        assert ann.nearest(dealt, centers, F.array(F.lit(1.0), F.lit(0.0)), 5, centers.count()).count() == len(kept)
    assert ann.recall(spark.createDataFrame([], "query_id string, chunk_id string"), spark.createDataFrame([], "query_id string, chunk_id string")) == 1.0


def table_of(spark, values):
    return spark.createDataFrame(pa.table({"chunk_id": pa.array(range(len(values)), pa.int64()), "vector": pa.array(list(values), pa.list_(pa.float32()))}))


def searched(dealt, centers, queries, k, probes):
    return [tuple(r) for r in ann.nearest_of_many(dealt, centers, queries, k, probes).select("query_id", "rank", "chunk_id", "distance").orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("block", [ann._BLOCK_VALUES, 64 * 64], ids=["large blocks", "small blocks"])
def test_many_queries_rank_as_sql_does(spark, monkeypatch, block):
    """Copies, multiples, and vectors a last digit apart: each distance and rank as in DuckDB, also where a list has more vectors than a block."""
    monkeypatch.setattr(ann, "_BLOCK_VALUES", block)
    monkeypatch.setattr(ann, "_LEAST", 16)
    rng = np.random.default_rng(5)
    values = rng.normal(size=(900, 8)).astype(np.float32)
    values[300:500] = values[3]
    values[500:600] = values[20:120] * rng.uniform(0.1, 9, (100, 1)).astype(np.float32)
    values[600:640] = values[20]
    values[600:640, 5] = np.nextafter(values[600:640, 5], np.float32(9))
    table = table_of(spark, values).repartition(3).cache()
    centers = ann.train(table)
    dealt = ann.deal(table, centers).cache()
    queries = table.filter("chunk_id % 20 IN (0, 3)").withColumnRenamed("chunk_id", "query_id")
    e = pa.table({"id": range(900), "v": list(values)})  # noqa: F841
    sql = """SELECT * FROM (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY array_cosine_distance(b.v::DOUBLE[8], a.v::DOUBLE[8]), b.id) AS r, b.id, array_cosine_distance(b.v::DOUBLE[8], a.v::DOUBLE[8])
      FROM e a, e b WHERE a.id % 20 IN (0, 3)) WHERE r <= 10 ORDER BY 1, 2"""
    assert searched(dealt, centers, queries, 10, centers.count()) == duckdb.sql(sql).fetchall()


def test_many_queries_look_into_their_lists_only(spark):
    rng = np.random.default_rng(6)
    table = table_of(spark, rng.normal(size=(700, 8)).astype(np.float32)).cache()
    centers = ann.train(table)
    dealt = ann.deal(table, centers).cache()
    queries = table.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    found = searched(dealt, centers, queries, 10, 3)
    for query in queries.collect():
        one = ann.nearest(dealt, centers, F.array(*[F.lit(float(v)) for v in query.vector]), 10, 3).collect()
        assert [r.chunk_id for r in one] == [r[2] for r in found if r[0] == query.query_id]


def test_many_queries_with_odd_values(spark):
    """As by distances row by row: numbers, then not numbers, then null, by id among equal ones."""
    nan, inf = float("nan"), float("inf")
    rows = [[1.0, 2.0], [nan, 1.0], [0.0, 0.0], [None, 1.0], [inf, 1.0], [-1.0, 0.5], [2.0, 4.0], None, [0.0, 0.0], [-inf, 0.0]]
    table = spark.createDataFrame(list(enumerate(rows)), "chunk_id long, vector array<float>").cache()
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], schemas.CENTERS)
    dealt = ann.deal(table, centers).cache()
    queries = table.withColumnRenamed("chunk_id", "query_id")
    pairs = dealt.crossJoin(queries.filter("vector is not null").withColumnRenamed("vector", "wanted")).withColumn("distance", vector_functions.cosine_distance("vector", "wanted"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last(F.round("distance", 9)), "chunk_id"))
    rounded = lambda found: [(q, r, c, d if d is None else str(round(d, 9) + 0.0)) for q, r, c, d in found]
    for k in (1, 4, 20):
        exact = pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance").orderBy("query_id", "rank")
        assert rounded(searched(dealt, centers, queries, k, 3)) == rounded(tuple(r) for r in exact.collect())
    assert searched(dealt, centers, queries.limit(0), 3, 3) == searched(dealt.limit(0), centers, queries, 3, 3) == []


def test_many_queries_make_no_row_for_a_pair(spark):
    """Twenty million pairs; as joined rows they took minutes."""
    rng = np.random.default_rng(7)
    values = rng.normal(size=(20_000, 64)).astype(np.float32)
    table = table_of(spark, values).repartition(4).cache()
    centers = spark.createDataFrame([(i, values[i].tolist()) for i in range(100)], schemas.CENTERS)
    dealt = ann.deal(table, centers).cache()
    assert dealt.count() == 20_000
    queries = table.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    began = time.monotonic()
    found = searched(dealt, centers, queries, 10, 100)
    assert len(found) == 10_000 and time.monotonic() - began < 40
    close = values.astype(float) / np.linalg.norm(values.astype(float), axis=1, keepdims=True)
    for query in (0, 9_980, 19_980):
        assert [r[2] for r in found if r[0] == query] == np.argsort(-(close @ close[query]))[:10].tolist()


def test_centers_of_one_file_are_fitted_by_many_tasks(spark):
    """A table that is read as one partition; its rounds were one task each."""
    table = table_of(spark, np.random.default_rng(8).normal(size=(600, 8)).astype(np.float32)).coalesce(1).cache()
    context = spark.sparkContext
    context.setJobGroup("fit", "")
    try:
        assert ann.train(table).count() == 24
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(stage) for job in tracker.getJobIdsForGroup("fit") for stage in tracker.getJobInfo(job).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sum(stage.numTasks >= context.defaultParallelism for stage in stages if stage) >= 10
