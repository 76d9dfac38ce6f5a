"""The training corpus from documents, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import workspace
from strandline.llm import bpe, exactdedup, langid, mixing, nearcopies
from strandline.llm.queries import BPE_FILE, PIECE_FILE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text or no letters) go."""
    return langid.determined(docs, langid.train(docs, public_tokenizers.path(PIECE_FILE)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; null counts as empty, a null id is smaller than any."""
    return exactdedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word similarity of 0.8 and more the document with the smallest doc_id stays.

    SimHash fingerprints find the close ones, the words what these miss. Documents
    with a null id stay; rows alike in id and text are one document.
    """
    return nearcopies.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null is a source of its own."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's tokens and of what they decode to; a null text has no tokens."""
    return bpe.encode_decode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Fingerprints and tokens are beyond SQL; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, whole texts of any length.

    Each stage takes any table with the columns of ``documents``, an empty one
    too, and keeps further columns, whatever these are called, up to the last
    stage. What a stage wrote for itself goes when its rows are safe, and these
    go when the next stage's are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for at, (_, stage) in enumerate(STAGES[:-1]):
        with workspace.scratch(spark) as made:
            docs = workspace.finish(stage(spark, docs, sf_dir), f"stage-{at}", made)
        if before is not None:
            workspace.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
