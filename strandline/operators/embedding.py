"""Embedding what the cache lacks, in batches under the provider's limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths, vectors
from strandline.functions.text import token_estimate
from strandline.operators import batching, images, store

#: A provider's limits for one input and one call.
INPUT_TOKENS, BATCH_TOKENS, BATCH_INPUTS = 32_000, 120_000, 950

Embedder = Callable[[Column], Column]


def offline(dimension: int) -> Embedder:
    """The deterministic embedding that needs no provider."""
    return lambda content: vectors.hash_embedding(content, dimension).cast("array<float>")


def input_tokens(content_type: Column | str, content: Column | str, pixels: Column | str) -> Column:
    """Tokens that an input counts: by bytes for text, by pixels for an image, 1000 for anything else."""
    kind = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.when(kind == "text", token_estimate(content)).when(kind == "image", vectors.image_tokens(pixels)).otherwise(1000)


def batches(inputs: DataFrame, group: str | None = None) -> DataFrame:
    """The call that each input goes into: ``inputs`` has id and tokens; inputs beyond INPUT_TOKENS are left out.

    In order of id, a new call begins when the present one has BATCH_INPUTS inputs or
    the next would take a non-empty one over BATCH_TOKENS; each ``group`` begins its own,
    without one all is a single sequence. Neither is ever one row or one task.
    """
    rows = inputs.filter(F.col("tokens") <= INPUT_TOKENS).select((F.col(group) if group else F.lit(0)).alias("group"), "id", "tokens")
    return batching.cut(rows, BATCH_INPUTS, BATCH_TOKENS)


def batch_summary(batched: DataFrame) -> DataFrame:
    return batched.groupBy("group", "batch").agg(F.count("*").alias("inputs"), F.sum("tokens").alias("tokens"))


def _inputs(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``input``: type, payload and tokens of what a multimodal embedder is sent; null for images that fail a check."""
    checked = images.validate(chunks.withColumn("__image", F.when(F.col("content_type") == "image", F.col("image_data").cast("string"))), "__image")
    uri = F.concat(F.lit("data:image/"), "image_format", F.lit(";base64,"), images.bare_base64("__image"))
    image = F.struct(F.lit("image_base64").alias("type"), uri.alias("payload"), vectors.image_tokens(F.col("width") * F.col("height")).cast("long").alias("tokens"))
    text = F.struct(F.lit("text").alias("type"), F.col("content").alias("payload"), token_estimate("content").cast("long").alias("tokens"))
    given = F.when(F.col("content_type") != "image", text).when(F.col("reason") == "accepted", image)
    return checked.withColumn("input", given).drop("__image", "reason", "image_format", "width", "height")


def resolve(chunks: DataFrame, cache: DataFrame, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, new cache rows): cached vectors first, each missing content embedded once.

    Chunks need content, content_type and image_data. Empty texts and inputs beyond
    INPUT_TOKENS have no vector. A multimodal embedder is sent the images of image
    chunks, of which those that fail ``images.validate`` have none; others get their captions.
    """
    hashed = chunks.withColumn("content_hash", paths.content_hash("content", "content_type", "image_data"))
    missing = hashed.join(cache.select("content_hash"), "content_hash", "left_anti")
    if getattr(embed, "multimodal", False):
        given = _inputs(missing).filter((F.col("input.tokens") <= INPUT_TOKENS) & (F.col("input.payload") != ""))
        once = given.groupBy("content_hash").agg(F.min("input").alias("input"))
        fresh = once.select("content_hash", embed.inputs(F.col("input")).alias("vector")).filter("vector is not null")
    else:
        given = missing.filter((token_estimate("content") <= INPUT_TOKENS) & (F.col("content") != ""))
        fresh = given.groupBy("content_hash").agg(F.min("content").alias("content")).select("content_hash", embed(F.col("content")).alias("vector"))
    known = cache.select("content_hash", "vector").unionByName(fresh)
    return store.probe_cache(hashed, known), fresh


def detect_dimension(spark, embed: Embedder) -> int:
    return spark.range(1).select(F.size(embed(F.lit("test"))).alias("n")).first()[0]


def rebuild_policy(indexed: int, total: int) -> str:
    """What to do with an approximate index: skip, defer (over 1000 vectors, under 5 % new) or rebuild."""
    if indexed == total:
        return "skip"
    new = total - indexed
    return "defer" if total > 1000 and 0 <= new < total * 0.05 else "rebuild"
