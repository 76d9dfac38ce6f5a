"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.workspace import discard, materialize


#: A node with so many edges, and with at least this share of all, is a hub.
HUB, HUB_SHARE = 50_000, 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge and isn't its component's smallest node, the root.

    ``edges`` has a and b, comparable ids that are not null; loops and repeats do
    no harm. Each round links a node's larger neighbours, then its smaller ones, to
    the least node around it; the number of rounds grows with the logarithm of the
    component's size. Minima are combined before the shuffle, and those of hubs are
    sent to the edges (``_with_least``), so a node with very many edges is no single
    task; every round's edges lie in the shared folder.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, mark[0]).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if mark[0] > HUB:  # read twice below, and once more for hubs
            large = materialize(large, "edges-large")
        small = _with_least(large, mark[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        new = materialize(small.unionByName(least).distinct(), "edges")
        discard(now)
        before, now, mark = mark, new, _mark(new)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` (u, v) with m, the least v of each u.

    Hubs can be no more than HUB_SHARE; their minima are sent to all edges, and these
    edges are dealt out in the join for the other nodes by a number that no other has.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    limit = max(HUB, 2 * count // HUB_SHARE)
    hubs = least.filter(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")).collect() if count > HUB else []
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    told = F.broadcast(edges.sparkSession.createDataFrame(hubs, least.select(F.col("u").alias("hub"), F.col("m").alias("hub_m")).schema))
    seen = edges.join(told, edges["u"] == told["hub"], "left").withColumn("salt", F.when(F.col("hub").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(1 << 20))).cast("int"))
    others = least.filter(F.col("n") <= limit).select(F.col("u").alias("other"), "m", F.lit(0).alias("other_salt"))
    both = seen.join(others, (F.col("u") == F.col("other")) & (F.col("salt") == F.col("other_salt")), "left")
    return both.select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """What tells one edge table from another: its size and two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
