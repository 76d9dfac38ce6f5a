"""Near-duplicates by SimHash: fingerprints of 64 bits that differ in at most three.

Links are found in two steps. Fingerprints within one flipped bit of a common
point differ in at most two bits, so each point's fingerprints belong together;
this contracts dense groups at a cost linear in their size. What is left is
found by pigeonring filtering: on the ring of four 16-bit segments, two
fingerprints within three bits have a segment from which the differences so far
stay within 0, 1, 2 and 3 as one goes round. The first two of these bounds make
a key to join on, the third prunes candidates before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.workspace import materialize

BITS, MOST = 64, 3
SEGMENTS = 4
SEED = 42
#: Fingerprints under one key that one task holds against those it begins with.
_HOT = 2000
#: Shingles hashed before their bits are summed.
_TOGETHER = 1 << 16


def shingles(text: str) -> list[bytes]:
    """Three-word shingles after lower-casing A-Z, repeats included; the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < 3:
        return [b" ".join(words)] if words else []
    return [b" ".join(three) for three in zip(words, words[1:], words[2:])]


def fingerprints_of(texts: Iterable[str | None], count: int) -> np.ndarray:
    """One signed 64-bit fingerprint for each of ``count`` texts, looked at one by one; 0 for a text without words."""
    votes = np.zeros((count, BITS), np.int64)
    sizes = np.zeros(count, np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []  # document and where its part of ``hashes`` begins

    def add_up() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, [at for _, at in owners], axis=0, dtype=np.int64)
            np.add.at(votes, [doc for doc, _ in owners], sums)
            hashes.clear()
            owners.clear()

    for doc, text in enumerate(texts):
        parts = shingles(text or "")
        sizes[doc] = len(parts)
        for begin in range(0, len(parts), _TOGETHER):
            owners.append((doc, len(hashes)))
            hashes.extend(map(xxhash.xxh64_intdigest, parts[begin : begin + _TOGETHER], repeat(SEED)))
            if len(hashes) >= _TOGETHER:
                add_up()
    add_up()
    ones = votes * 2 > sizes[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<i8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) for each row of ``docs``; no shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of((value.as_py() for value in batch.column(1)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def _within_two(nodes: DataFrame) -> DataFrame:
    """Edges between fingerprints that share a point at most one bit from each; a point has at most 65 of them."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    points = nodes.select("node", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.withColumn("least", F.min("node").over(Window.partitionBy("point")))
    return least.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def _segment(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (at % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _ring_keys() -> Column:
    """For each segment that a chain may begin with, and each bit that may differ in the next one, a key to join on."""
    flips = [0, *[1 << b for b in range(16)]]
    keys = [
        F.struct(
            F.lit(i).alias("start"),
            F.lit(flip).alias("flip"),
            (F.shiftleft(F.lit(i).cast("long"), 32) + F.shiftleft(_segment(F.col("fp"), i), 16) + _segment(F.col("fp"), i + 1).bitwiseXOR(F.lit(flip).cast("long"))).alias("key"),
        )
        for i in range(SEGMENTS)
        for flip in flips
    ]
    return F.explode(F.array(*keys)).alias("k")


def _within(start: Column, differ: Column) -> Column:
    """Whether the chain from segment ``start`` stays within its third bound, and all bits within MOST."""
    third = F.lit(False)
    for i in range(SEGMENTS):
        ring = F.bit_count(_segment(differ, i)) + F.bit_count(_segment(differ, i + 1)) + F.bit_count(_segment(differ, i + 2))
        third = F.when(start == i, ring <= MOST * 3 // SEGMENTS).otherwise(third)
    return third & (F.bit_count(differ) <= MOST)


def _pigeonring(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of fingerprints within MOST bits that are in different classes.

    ``nodes`` has node, fp and class. Keys that only one class has are dropped
    before the join, so a dense group that is one class already costs no pairs; a
    key with many fingerprints of several classes is dealt out to many tasks.
    """
    probes = nodes.select("fp", "class", _ring_keys()).select("fp", "class", "k.start", "k.flip", "k.key")
    by_key = Window.partitionBy("key")
    salts = F.ceil(F.count("*").over(by_key) / _HOT).cast("int")
    probes = probes.withColumns({"low": F.min("class").over(by_key), "high": F.max("class").over(by_key), "salts": salts}).filter("low <> high").drop("low", "high")
    exact = probes.filter("flip = 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    near = probes.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).alias("y")
    fits = _within(F.col("x.start"), F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    linked = exact.join(near, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.class") != F.col("y.class")) & fits)
    return linked.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) within MOST bits: under each pigeonring key the least node and those near it.

    Linear in the nodes, however many share a key, so not all pairs: for callers who look further on their own.
    """
    probes = nodes.select("node", "fp", _ring_keys()).select("node", "fp", "k.start", "k.key")
    centered = probes.withColumn("least", F.min(F.struct("node", "fp")).over(Window.partitionBy("key"))).filter("node <> least.node")
    near = centered.filter(_within(F.col("start"), F.col("fp").bitwiseXOR(F.col("least.fp"))))
    return near.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()


def of_hashes(hashes: np.ndarray) -> int:
    """The signed fingerprint of a text's shingles' hashes (unsigned 64-bit numbers), of shingles of any length."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def link(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of ``docs`` (doc_id, text).

    The component is named by the smallest doc_id that links lead to. Texts
    without words (null, empty, white space) have fingerprint zero and are linked
    like any other. Rows with equal ids each keep their fingerprint and tie their
    components together, as one document would. A row with a null id is no
    link: it gets the component of the rows with its fingerprint, null without
    one. Copies are never paired: linking works on distinct fingerprints.
    """
    return link_fingerprints(materialize(fingerprints(docs), "simhash-fingerprints"))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """``link`` from doc_id and fp on; reads ``fps`` several times."""
    nodes = materialize(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # one id with several texts, or one text's fingerprint with several ids: the node's other ids are its own
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    tied = fps.join(several, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("id"), "node")
    ties = tied.join(tied.groupBy("id").agg(F.min("node").alias("least")), "id").select(F.col("node").alias("a"), F.col("least").alias("b"))

    first = materialize(components(_within_two(nodes).unionByName(ties)), "simhash-first")
    classes = materialize(nodes.join(first, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("class")), "simhash-classes")
    second = components(_pigeonring(classes)).withColumnRenamed("node", "class")
    named = classes.join(second, "class", "left").select("fp", F.coalesce("root", "class").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with all their columns; rows with a null id stay."""
    dropped = link(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
