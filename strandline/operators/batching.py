"""Calls of bounded size over a long sequence, without one row or task that holds all of it.

Where a call ends depends on where it began, so the sequence looks serial. It is cut
into blocks of rows that follow each other. A block finds, for each of the few rows
where its first call may begin, where the first call of the next block then begins
and how many calls lie between: a small table, whatever the block's size. These
tables are composed, FAN blocks at a time and then FAN of the results, until one row
is left; on the way back each block learns where its first call truly begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.workspace import materialize

#: Rows meant for a block, and blocks that are composed together.
BLOCK_ROWS, FAN = 100_000, 64
_MAPS = "block long, entry int, exit int, calls long, reset boolean"
_PLACES = "block long, entry int, calls long"


def _new_groups(keys: np.ndarray, before: str | None, first: bool) -> np.ndarray:
    """Where a row's key differs from the one before it; None is a key."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if len(keys) and not first:
        new[0] = keys[0] != before
    return new


def _next_starts(tokens: np.ndarray, new: np.ndarray, own: int, most_rows: int, most_tokens: int) -> np.ndarray:
    """For each of the first ``own`` rows, where the call after one that begins there begins."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(own)
    by_tokens = np.searchsorted(sums, sums[at] + most_tokens, side="right") - 1
    groups = np.append(np.flatnonzero(new), len(tokens))
    by_group = groups[np.searchsorted(groups, at, side="right")]
    return np.minimum(np.maximum(np.minimum(by_tokens, at + most_rows), at + 1), by_group)


def _block_map(following: np.ndarray, new: np.ndarray, own: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exit, calls and reset for each entry; calls count from the block's last group on where it has one behind the entry."""
    to, calls = following.copy(), np.ones(own, np.int64)
    while (inside := to < own).any():  # pointers are doubled
        calls = calls + np.where(inside, calls[np.where(inside, to, 0)], 0)
        to = np.where(inside, to[np.where(inside, to, 0)], to)
    entry = np.arange(entries)
    here = np.minimum(entry, max(own - 1, 0))
    passes = entry >= own  # the block lies within the call
    starts = np.flatnonzero(new[:own])
    reset = ~passes & (len(starts) > 0) & (entry <= (starts[-1] if len(starts) else -1))
    count = np.where(reset, calls[starts[-1]] if len(starts) else 0, calls[here] if own else 0)
    return np.where(passes, entry - own, to[here] - own if own else 0), np.where(passes, 0, count), reset


def _tables(frame: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    ordered = frame.sort_values(["block", "entry"])
    blocks = ordered["block"].unique()
    return blocks, [ordered[c].to_numpy().reshape(len(blocks), -1) for c in ("exit", "calls", "reset")]


def _compose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one parent as one block."""
    blocks, (exits, calls, resets) = _tables(frame)
    at, count, reset = np.arange(exits.shape[1]), np.zeros(exits.shape[1], np.int64), np.zeros(exits.shape[1], bool)
    for b in range(len(blocks)):
        count = np.where(resets[b, at], calls[b, at], count + calls[b, at])
        reset = reset | resets[b, at]
        at = exits[b, at]
    return pd.DataFrame({"block": key[0], "entry": np.arange(len(at)), "exit": at, "calls": count, "reset": reset})


def _walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Entry and calls so far of each block of one parent, whose own are known."""
    blocks, (exits, calls, resets) = _tables(frame)
    at, count, out = int(frame["p_entry"].iloc[0]), int(frame["p_calls"].iloc[0]), []
    for b, block in enumerate(blocks):
        out.append((block, at, count))
        count = int(calls[b, at]) + (0 if resets[b, at] else count)
        at = int(exits[b, at])
    return pd.DataFrame(out, columns=["block", "entry", "calls"])


def _places(maps: DataFrame, blocks: int) -> DataFrame:
    """Where each block's first call begins, and how many calls its group had before."""
    parent = maps.withColumn("parent", F.floor(F.col("block") / FAN))
    if blocks <= FAN:
        known = parent.withColumns({"p_entry": F.lit(0), "p_calls": F.lit(0).cast("long")})
    else:
        above = materialize(parent.groupBy("parent").applyInPandas(_compose, _MAPS), "call-maps")
        found = _places(above, -(-blocks // FAN)).select(F.col("block").alias("parent"), F.col("entry").alias("p_entry"), F.col("calls").alias("p_calls"))
        known = parent.join(found, "parent")
    return materialize(known.groupBy("parent").applyInPandas(_walk, _PLACES), "call-places")


def cut(rows: DataFrame, most_rows: int, most_tokens: int) -> DataFrame:
    """``rows`` (group, id, tokens) with ``batch``, from 0 in each group (null is one too), in the order of id and tokens.

    A call takes rows until it has ``most_rows`` or the next one would take it over
    ``most_tokens``; a row beyond that is a call of its own. Groups of any size are
    cut in blocks; the driver sees one row a block.
    """
    count = rows.count()
    order = ["__key", "id", "tokens"]
    keyed = rows.withColumn("__key", F.col("group").cast("string"))
    dealt = keyed.repartitionByRange(max(1, -(-count // BLOCK_ROWS)), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "call-rows")
    about = dealt.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n"), F.max_by("__key", "__at").alias("last")).orderBy("part").collect()
    number = {r.part: b for b, r in enumerate(about)}
    ends = np.cumsum([r.n for r in about])
    last = [r["last"] for r in about]
    told = rows.sparkSession.sparkContext.broadcast((number, ends, last))

    columns = [*dealt.columns]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its block, and again in those before it whose last call may reach it."""
        number, ends, _ = told.value
        for batch in batches:
            places = batch.column(columns.index("__at")).to_numpy()
            for part in np.unique(places >> 33):
                block = number[int(part)]
                begin = int(ends[block - 1]) if block else 0
                mine = np.flatnonzero(places >> 33 == part)
                at = (places[mine] & ((1 << 33) - 1)) + begin
                for target in range(block, -1, -1):
                    reached = at < (int(ends[target]) + most_rows if target < block else 1 << 62)
                    if not reached.any():
                        break
                    some = batch.take(pa.array(mine[reached]))
                    arrays = [pa.array(at[reached]) if c == "__at" else some.column(i) for i, c in enumerate(columns)]
                    n = int(reached.sum())
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, target, np.int64)), pa.array(np.full(n, target == block))], names=[*columns, "block", "own"])

    placed = dealt.mapInArrow(spread, dealt.withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True)}).schema)

    def parts(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
        _, _, last = told.value
        table = table.sort_by("__at")
        block, own = table["block"][0].as_py(), int(table["own"].to_numpy().sum())
        new = _new_groups(np.array(table["__key"].to_pylist(), object), last[block - 1] if block else None, block == 0)
        return table, new, _next_starts(table["tokens"].to_numpy().astype(np.int64), new, own, most_rows, most_tokens), own

    def mapped(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, new, following, own = parts(table)
        exits, calls, reset = _block_map(following, new, own, most_rows)
        return pa.table({"block": pa.array([key[0].as_py()] * most_rows, pa.int64()), "entry": pa.array(np.arange(most_rows), pa.int32()), "exit": pa.array(exits, pa.int32()), "calls": pa.array(calls), "reset": pa.array(reset)})

    def numbered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, new, following, own = parts(table)
        start, at = np.zeros(own, np.int64), table["entry"][0].as_py()
        while at < own:
            start[at] = 1
            at = int(following[at])
        total = np.cumsum(start)
        group = np.maximum.accumulate(np.where(new[:own], np.arange(own), -1))
        batch = np.where(group >= 0, total - total[np.maximum(group, 0)], table["calls"][0].as_py() + total - 1)
        mine = table.slice(0, own)
        return pa.table({"group": mine["group"], "batch": pa.array(batch), "id": mine["id"], "tokens": mine["tokens"]})

    out = dealt.select("group", F.lit(0).cast("long").alias("batch"), "id", "tokens")
    if not about:
        return out
    if len(about) == 1:  # nothing to compose
        alone = dealt.withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True), "entry": F.lit(0), "calls": F.lit(0).cast("long")})
        return alone.groupBy("block").applyInArrow(numbered, out.schema)
    maps = placed.select("block", "own", "__at", "__key", "tokens").groupBy("block").applyInArrow(mapped, _MAPS)
    places = _places(materialize(maps, "call-maps"), len(about))
    known = placed.join(F.broadcast(places), "block")  # a row a block
    return known.groupBy("block").applyInArrow(numbered, out.schema)
