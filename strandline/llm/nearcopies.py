"""Near-copies by SimHash and by their words: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints of the same shingles, with pigeonring filtering, find what
differs little; these groups are one class before anything else is compared.
Similar texts may differ in more bits than that, so the rest goes by the words, and
no pair is missed: shingles have one order for all texts, and of two sets that are
that similar the larger has one of its first n - ceil(0.8 n) + 1 shingles among the
first n - ceil(8/9 n) + 1 of the other (prefix filter), their sizes differ by at most
a fifth, and enough shingles follow the first one that they share. What these three
leave, and a bit vector of each text doesn't rule out, is compared by the texts.
The order puts frequent shingles last; which ones are frequent is counted over a
sample of large tables, since the order decides on the cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.components import components
from strandline.llm.text import release
from strandline.workspace import discard, materialize

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
SEED = 42
#: Rows that the frequent shingles are counted over, how many of these make one frequent, and how many are told to each task.
_SAMPLE, _FREQUENT, _TOLD = 50_000, 8, 1 << 20
#: Postings of a key that are held against each other in one task; those of a key with more are dealt out.
_HOT = 2000
#: Rounds end when one joins at most one in so many classes.
FEW = 400
#: Shingles that are put out together.
_TOGETHER = 1 << 16
#: Bits of a text's vector, in words of 64.
BITS = 16 * 64


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """Distinct shingles after lower-casing A-Z; the whole sequence where there are fewer words, even none."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, in ascending order."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words), repeat(SEED)), np.uint64))


def similar(a: str | None, b: str | None, words: int = WORDS, least: tuple[int, int] = LEAST) -> bool:
    x, y = shingles(a, words), shingles(b, words)
    both = len(x & y)
    return both * least[1] >= (len(x) + len(y) - both) * least[0]


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles in ascending order, and in how many sampled rows each stands."""
    every = -(-docs.count() // _SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(every, 1))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found, size = [], 0
            for value in batch.column(0):
                found.append(hashes(value.as_py(), words))
                size += len(found[-1])
                if size >= _TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    counts = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= _FREQUENT)
    rows = counts.orderBy(F.desc("n"), "key").limit(_TOLD).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(size: int, least: tuple[int, int] = LEAST) -> int:
    """How many of its first shingles a set of ``size`` is looked for by."""
    return size + (-size * least[0] // least[1]) + 1


def _indexed(size: Column, least: tuple[int, int]) -> Column:
    """How many of its first shingles a set is found by, by sets no smaller: two sets of one size share 2s / (1 + s) of it."""
    return size - F.floor((size * 2 * least[0] + least[0] + least[1] - 1) / (least[0] + least[1])) + 1


def _texts(docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """row (a number), doc_id, h (a hash of the text), n (distinct shingles), fp, bits and keys (the prefix) of each row, from one pass over the texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequent, counts = told.value
        row = TaskContext.get().partitionId() << 33

        def put_out(owners: list, sizes: list, fps: list, bits: list, keys: list) -> pa.RecordBatch:
            nonlocal row
            starts = pa.array(np.arange(len(owners) + 1) * (BITS // 64), pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(bits))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))]
            at = pa.array(owners)
            row += len(owners)
            columns = [pa.array(np.arange(row - len(owners), row)), batch.column(0).take(at), batch.column(2).take(at), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *lists]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "h", "n", "fp", "bits", "keys"])

        for batch in batches:
            parts, size = ([], [], [], [], []), 0
            for doc, value in enumerate(batch.column(1)):
                own = hashes(value.as_py(), words)
                fp, odd = simhash.of_hashes(own), parities(own)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    own = own[np.argsort(np.where(frequent[at] == own, counts[at], 0), kind="stable")]
                for part, found in zip(parts, (doc, len(own), fp, odd, own[: prefix(len(own), least)])):
                    part.append(found)
                size += len(parts[-1][-1])
                if size >= _TOGETHER:
                    yield put_out(*parts)
                    parts, size = ([], [], [], [], []), 0
            if parts[0]:
                yield put_out(*parts)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # the numbers hold once the rows are written
    return materialize(rows.mapInArrow(run, f"row long, doc_id {id_type}, h long, n int, fp long, bits array<bigint>, keys array<bigint>"), "near-texts")


def _may_fit(x: str, y: str, least: tuple[int, int]) -> Column:
    """Whether two sets may be similar, by their sizes and what follows their first common shingle; ``x`` and ``y`` have size and place."""
    a, b, i, j = F.col(f"{x}.size"), F.col(f"{y}.size"), F.col(f"{x}.place"), F.col(f"{y}.place")
    both = F.least(a - i, b - j).cast("long")
    return (both * (least[0] + least[1]) >= (a + b).cast("long") * least[0]) & (F.least(a, b).cast("long") * least[1] >= F.greatest(a, b).cast("long") * least[0])


def parities(found: np.ndarray) -> np.ndarray:
    """BITS bits, one a hash modulo BITS: whether an odd number of the hashes falls there.

    A hash in one set alone changes one bit, so two vectors differ in no more bits than the sets have such hashes.
    """
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bits_fit(x: str, y: str, least: tuple[int, int]) -> Column:
    """Whether few enough bits differ: sets of a and b shingles that are similar differ in at most (a + b) (1 - s) / (1 + s)."""
    apart = sum((F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return apart.cast("long") * (least[1] + least[0]) <= (F.col(f"{x}.n") + F.col(f"{y}.n")).cast("long") * (least[1] - least[0])


def _maybe(pairs: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b, u, v) that the vectors of their texts don't rule out."""
    x, y = (texts.select(F.col("row").alias(end), F.struct("n", "bits").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").filter(_bits_fit("x", "y", least)).select("a", "b", "u", "v").distinct()


def _sure(pairs: DataFrame, texts: DataFrame, docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """u and v of those of ``pairs`` (a, b, u, v) whose texts are similar; only these texts are shuffled."""
    rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    ids = texts.select("row", "doc_id", "h").join(rows, "row", "left_semi")
    whole = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(ids, ["doc_id", "h"]).select("row", "text")
    full = pairs.join(whole.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(whole.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            good = [similar(x.as_py(), y.as_py(), words, least) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return full.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, root) of both: where ``first`` leads to a node of ``second``, its root counts."""
    through = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return through.unionByName(second)


def _of_several(classes: DataFrame) -> DataFrame:
    """Postings of the keys that more than one class has, and by which some text is found; ``count`` of them."""
    by_key = Window.partitionBy("key")
    marks = {"low": F.min("class").over(by_key), "high": F.max("class").over(by_key), "some": F.max("index").over(by_key), "count": F.count("*").over(by_key)}
    return classes.withColumns(marks).filter("low <> high AND some").drop("low", "high", "some")


def _links(pairs: DataFrame, texts: DataFrame, docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """(node, root) of the classes that similar texts among ``pairs`` (a, b, u, v) link."""
    pairs = materialize(pairs, "near-pairs")
    edges = _sure(pairs, texts, docs, words, least).select(F.col("u").alias("a"), F.col("v").alias("b"))
    linked = materialize(components(edges), "near-linked")
    discard(pairs)
    return linked


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """Pairs that SimHash finds: rows of one fingerprint, and fingerprints that pigeonring filtering leaves."""
    nodes = materialize(texts.groupBy("fp").agg(F.min("row").alias("node")), "near-fingerprints")
    same = texts.join(nodes, "fp").filter("row <> node").select(F.col("node").alias("a"), F.col("row").alias("b"))
    return same.unionByName(simhash.stars(nodes)).select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))


def link(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, h (xxhash64 of the text) and component_id of each row that is linked to a smaller one; reads ``docs`` several times.

    Rows go by doc_id, those of one id by h; the least names the component. Texts
    without words are copies of each other; rows with a null id are no link. First
    come the groups that fingerprints show. Then, in rounds, each text is compared
    with one text of another class for each shingle in its prefix, another one
    every round, and what is similar becomes one class: the cost of a round
    follows the number of shingles, and a dense group is one class soon. When a
    round joins few classes, all pairs of texts of different classes that are
    left and may be similar by their prefixes are looked at, a key with many texts
    by many tasks: by their vectors in the join, by their texts if these allow it.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    texts = _texts(docs, words, least)
    linked = _links(_maybe(_by_fingerprint(texts), texts, least), texts, docs, words, least)
    classed = texts.join(linked.withColumnsRenamed({"node": "row"}), "row", "left").select("row", F.col("n").alias("size"), F.coalesce("root", "row").alias("class"), F.posexplode("keys").alias("place", "key"))
    classes = materialize(_of_several(classed.withColumn("index", F.col("place") < _indexed(F.col("size"), least))), "near-shared")
    number = 0
    while True:
        pivot = F.min(F.struct(~F.col("index"), F.xxhash64(F.lit(number), "row").alias("h"), "row", "size", "place", "class")).over(Window.partitionBy("key"))
        p = classes.withColumn("pivot", pivot).filter("class <> pivot.class").withColumn("own", F.struct("size", "place"))
        pairs = p.filter(_may_fit("own", "pivot", least)).select(F.col("row").alias("a"), F.col("pivot.row").alias("b"), F.col("class").alias("u"), F.col("pivot.class").alias("v"))
        joined = _links(_maybe(pairs.distinct(), texts, least), texts, docs, words, least)
        linked = materialize(_compose(linked, joined), "near-linked")
        before, merged = classes.select("class").distinct().count(), joined.count()
        now = classes.join(joined.withColumnsRenamed({"node": "class", "root": "top"}), "class", "left").withColumn("class", F.coalesce("top", "class"))
        now = materialize(_of_several(now.select("row", "size", "class", "place", "key", "index")), "near-classes")
        discard(classes)
        classes, number = now, number + 1
        if merged * FEW <= before:
            break
    seen = classes.join(texts.select("row", "n", "bits"), "row").withColumn("salts", F.ceil(F.col("count") / _HOT).cast("int"))
    x = seen.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).alias("x")
    y = seen.filter("index").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.row") > F.col("y.row")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.class") != F.col("y.class")) & larger & _may_fit("x", "y", least) & _bits_fit("x", "y", least))
    pairs = pairs.select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.col("x.class").alias("u"), F.col("y.class").alias("v")).distinct()
    linked = materialize(_compose(linked, _links(pairs, texts, docs, words, least)), "near-linked")

    members = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()).join(texts.select(F.col("row").alias("node"), F.struct("doc_id", "h").alias("id")), "node")
    named = members.join(members.groupBy("root").agg(F.min("id").alias("least")), "root").filter("id <> least")
    return named.select("id.doc_id", "id.h", F.col("least.doc_id").alias("component_id")).distinct()


def representatives(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``docs`` but those linked to a smaller doc_id (``link``), with all their columns.

    Rows with a null id stay; rows alike in id and text are one document.
    """
    gone = link(docs, words, least).select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h"))
    return docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left_anti").select(*[f"`{c}`" for c in docs.columns])
