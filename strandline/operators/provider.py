"""Embedding and reranking by a remote provider: batched calls from Arrow batches, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import token_estimate
from strandline.operators.embedding import BATCH_INPUTS, BATCH_TOKENS, INPUT_TOKENS

RETRIES = 3


class Refused(RuntimeError):
    """The provider's answer was an error; ``status`` is its HTTP code."""

    def __init__(self, status: int, said: str = ""):
        super().__init__(f"status {status}: {said}")
        self.status = status


def with_retries(call: Callable, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after a timeout (in 1, 4, 9 s) and after 429 or a server error (in 30, 60, 90 s)."""

    def run(*args):
        for attempt in range(1, RETRIES + 2):
            try:
                return call(*args)
            except TimeoutError:
                pause = attempt**2
                if attempt > RETRIES:
                    raise
            except Refused as error:
                pause = 30 * attempt
                if attempt > RETRIES or (error.status != 429 and error.status < 500):
                    raise
            wait(pause)
        raise AssertionError("unreachable")

    return run


def calls_of(tokens: Sequence[int]) -> Iterator[list[int]]:
    """Positions of the inputs in each call, under the limits of a call; over-long ones are in none."""
    batch, total = [], 0
    for at, size in enumerate(tokens):
        if size > INPUT_TOKENS:
            continue
        if batch and (len(batch) >= BATCH_INPUTS or total + size > BATCH_TOKENS):
            yield batch
            batch, total = [], 0
        batch.append(at)
        total += size
    if batch:
        yield batch


def calls(texts: Sequence[str]) -> Iterator[list[int]]:
    return calls_of([(len(text.encode()) + 2) // 3 for text in texts])


def remote_embedder(request: Callable[[list[str]], list[list[float]]], wait: Callable[[float], None] = time.sleep) -> Callable[[Column], Column]:
    """An embedder for ``embedding.resolve``: ``request`` maps texts to vectors and runs on the executors.

    A call that comes back with another number of vectors fails its task.
    """
    ask = with_retries(request, wait)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            out: list = [None] * len(texts)
            for positions in calls(texts):
                vectors = ask([texts[i] for i in positions])
                if len(vectors) != len(positions):
                    raise ValueError(f"{len(positions)} texts sent, {len(vectors)} vectors came back")
                for i, vector in zip(positions, vectors, strict=True):
                    out[i] = vector
            yield pd.Series(out)

    return lambda content: embed(content)


class MultimodalEmbedder:
    """An embedder that is sent images as such: ``request`` maps inputs to vectors and runs on the executors.

    An input is {"type": "text", "text": ...} or {"type": "image_base64",
    "image_base64": "data:image/png;base64,..."}. A task keeps up to ``at_once`` calls on
    the way and puts their answers in order. A call that comes back with another number
    of vectors, or fails for good, leaves its own inputs without one.
    """

    multimodal = True

    def __init__(self, request: Callable[[list[dict]], list[list[float]]], at_once: int = 4, wait: Callable[[float], None] = time.sleep):
        self.request, self.at_once, self.wait = request, at_once, wait

    def __call__(self, content: Column) -> Column:
        """A query's or chunk's text alone."""
        return self.inputs(F.struct(F.lit("text").alias("type"), content.alias("payload"), token_estimate(content).cast("long").alias("tokens")))

    def inputs(self, given: Column) -> Column:
        """The vector of each struct of type, payload (a text or a data URI) and tokens."""
        ask, at_once = with_retries(self.request, self.wait), self.at_once

        def answer(inputs: list[dict]) -> list:
            try:
                vectors = ask(inputs)
            except (TimeoutError, Refused):
                return [None] * len(inputs)
            return list(vectors) if len(vectors) == len(inputs) else [None] * len(inputs)

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            with ThreadPoolExecutor(at_once) as pool:
                for frame in batches:
                    key = {"text": "text", "image_base64": "image_base64"}
                    rows = [{"type": kind, key[kind]: payload or ""} for kind, payload in zip(frame["type"], frame["payload"])]
                    groups = list(calls_of(frame["tokens"].fillna(0).astype(int).tolist()))
                    out: list = [None] * len(rows)
                    for positions, vectors in zip(groups, pool.map(answer, [[rows[i] for i in g] for g in groups])):
                        for i, vector in zip(positions, vectors):
                            out[i] = vector
                    yield pd.Series(out, dtype=object)

        return embed(given)


def remote_scorer(request: Callable[[str, list[str]], list[float | None]], wait: Callable[[float], None] = time.sleep) -> Callable[[Column, Column], Column]:
    """A scorer for ``search.rerank``; documents that the provider leaves out (None) drop out of the results."""
    ask = with_retries(request, wait)

    @F.pandas_udf("double")
    def score(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(ask(query.iloc[0], content.fillna("").tolist()) if len(query) else [], dtype="float64")

    return score
