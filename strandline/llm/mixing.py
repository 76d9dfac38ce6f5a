"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected in target / source_size copies. Along a
fixed order of the source's documents these expectations add up; shifted by one
random offset a source, a document is taken once for each whole number that the
sum crosses on it. The order is by size class, so that the words taken follow
the target as closely as the copies do, and by a hash of the id within a class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import whole, words
from strandline.workspace import materialize

#: Rows meant for one part of a size class, and at most so many bits that split a class into parts.
PART_ROWS, MOST_BITS = 512, 20
#: A part with so many times the rows meant for it holds rows that are alike; those are dealt out by their place in the table.
ALIKE = 16


def size_class(size: Column) -> Column:
    """Sizes with the same length in bits and the same four leading bits share a class, which rises with size."""
    bits = F.bin(size)
    return F.length(bits) * 16 + F.conv(F.substring(bits, 1, 4), 2, 10).cast("int")


def _hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def _by_name(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0 in the order of ``source``, null last; the ranges of names are counted, then ranked one by one."""
    dealt = materialize(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("__range", F.spark_partition_id()), "mix-sources")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    # a row for each range, of which there are no more than shuffle partitions
    firsts = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_last("source")))
    return dealt.join(F.broadcast(firsts), "__range").withColumn("place", F.col("__first") + rank - 1).drop("__range", "__first")


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to rows of source and source_size: shares of the total by weight, up to ``most`` x source_size.

    All shares rise with one level. The level that would spend the total is worked
    out again without the sources that it fills, until it fills no other; each
    round is one sum over the sources. No source, or none of any size, has level 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialize(_by_name(sources).select("source", "source_size", weight.alias("weight")), "mix-weights")
    ceiling = F.col("source_size") * most
    level, filled = 0.0, -1
    while True:
        full = (ceiling <= F.lit(level) * F.col("weight")) if filled >= 0 else F.lit(False)
        sums = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"), F.count_if(full).alias("filled"),
        ).first()
        if not sums.open or sums.filled == filled:
            break
        level, filled = (sums.total - sums.spent) / sums.open, sums.filled
    return weighed.select("source", "source_size", F.least(ceiling.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Add size, source_size, target, copies and taken (copies x size) to each row of ``docs``.

    ``docs`` has doc_id, text and source. Size counts words; a null or empty text
    has 0. Null is a source of its own, last by name. Sources weigh ``weights`` in
    turn and share the sum of all sizes; none goes beyond ``most`` x its size. A
    source of size 0 takes nothing. Null and repeated ids each count as a row; rows
    alike in id, text and source may change places, which changes no figure.
    Columns of ``docs`` called like the added ones are replaced.

    The sums run over parts of a size class, as many as the rows need, then over
    classes, so no task ever gets a source whole; many rows that are alike are
    parts of their own, behind the others of their class. Reruns give the same copies.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.drop(*added).withColumn("size", F.size(words(whole("text"))).cast("long"))
    hashed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), whole("text"))), 1, 16)
    rows = rows.withColumns({"__class": size_class(F.col("size")), "__hash": hashed, "__source": F.col("source")})
    count = docs.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(count, 1) / PART_ROWS))))
    rows = rows.withColumn("__part", F.expr(f"shiftright(cast(conv(substring(__hash, 1, 8), 16, 10) as long), {32 - bits})"))
    summed = lambda rows, *keys: materialize(rows.groupBy("__source", "__class", *keys).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-parts")
    parts, keys = summed(rows, "__part"), ["__part"]
    limit = ALIKE * max(PART_ROWS, count >> bits)
    large = parts.filter(F.col("n") > limit)
    if not large.isEmpty():
        rows, keys = _deal_alike(rows, large, limit, bits)
        parts = summed(rows, *keys)
    earlier = lambda of, order: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = parts.groupBy("__source", "__class").agg(F.sum("n").alias("n")).withColumn("__before_class", earlier(["__source"], ["__class"])).drop("n")
    within = parts.withColumn("__before_part", earlier(["__source", "__class"], keys)).drop("n", "words")
    offset = _hash32(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))) / 4294967296.0
    sources = targets(parts.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights, most).withColumn("__offset", offset)

    starts = _join(_join(within, classes, "__source", "__class"), sources.withColumnRenamed("source", "__source"), "__source")
    placed = _join(rows, starts, "__source", "__class", *keys)
    order = Window.partitionBy("__source", "__class", *keys).orderBy("__hash", "doc_id", "size")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda n: F.floor(n * F.col("__rate") + F.col("__offset"))
    return (
        placed.withColumn("__rank", F.col("__before_class") + F.col("__before_part") + F.row_number().over(order))
        .withColumn("__rate", rate)
        .withColumn("copies", crossed(F.col("__rank")) - crossed(F.col("__rank") - 1))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[c for c in docs.columns if c not in added], *added)
    )


def _deal_alike(rows: DataFrame, large: DataFrame, limit: int, bits: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with what splits a size class, and these columns; no part has many times ``limit`` rows.

    Hashes follow id and text, so the ``large`` parts, those beyond ``limit``, hold one hash
    very often. Such hashes are looked for in these parts alone and get parts of their
    own, by the rows' places. Both lists are short: their rows have to be in the table.
    """
    place = ["__source", "__class", "__part"]
    told = F.broadcast(large.select(*[F.col(c).alias(f"l{c}") for c in place]))
    inside = rows.select(*place, "__hash").join(told, F.expr(" AND ".join(f"{c} <=> l{c}" for c in place)), "left_semi")
    often = inside.groupBy("__source", "__class", "__hash").agg(F.ceil(F.count("*") / limit).cast("int").alias("__slices")).filter("__slices > 1")
    often = materialize(often.withColumnsRenamed({c: f"l{c}" for c in ("__source", "__class", "__hash")}), "mix-alike")
    same = F.expr(" AND ".join(f"{c} <=> l{c}" for c in ("__source", "__class", "__hash")))
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(often), same, "left").drop("l__source", "l__class", "l__hash")
    alike = F.col("__slices").isNotNull()
    return rows.withColumns({"__part": F.when(alike, F.lit(1 << bits)).otherwise(F.col("__part")), "__alike": F.when(alike, F.col("__hash")).otherwise(""), "__slice": F.when(alike, F.pmod("__row", "__slices")).otherwise(0)}), ["__part", "__alike", "__slice"]


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join in which null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"{k}_right"]) for k in keys]
    return left.join(renamed, same).drop(*[f"{k}_right" for k in keys])


def emit(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with all its columns, whatever these are called."""
    own = {c: c if c in ("doc_id", "text", "source") else f"__own{i}" for i, c in enumerate(docs.columns)}
    mixed = mix(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()]), weights, most, seed)
    taken = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(k).alias(c) for c, k in own.items()])
