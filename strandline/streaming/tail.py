"""The newest lines of a log as a stream keeps them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions.text import log_level
from strandline.operators import metadata

#: Lines kept, and rings that one log's lines are dealt to, so that a busy log is not one key.
KEPT, RINGS = 500, 8
RING = "log string, ring int, ts timestamp, event_id long, message string"
_STATE = "ts array<timestamp>, event_id array<long>, message array<string>"


def _keep(kept: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The ring after this batch; each part of the batch is cut before the next is looked at."""
        columns = ["ts", "event_id", "message"]
        ring = pd.DataFrame(dict(zip(columns, state.get)) if state.exists else {c: [] for c in columns})
        for frame in frames:
            both = frame[columns] if ring.empty else pd.concat([ring, frame[columns]])
            ring = both.drop_duplicates("event_id").sort_values(["ts", "event_id"], ascending=False).head(kept)
        state.update(tuple(ring[c].tolist() for c in columns))
        yield ring.assign(log=key[0], ring=key[1])[["log", "ring", *columns]]

    return run


def rings(logs: DataFrame, kept: int = KEPT, count: int = RINGS) -> DataFrame:
    """A stream of log lines (log, ts, event_id, message) as rings: each batch gives the rings that it changes, whole.

    Lines are placed by their time, so a late one gets its place or, if it is older than
    all that are kept, none; a line that comes twice is kept once. A ring never has more than ``kept`` lines.
    """
    rows = logs.select(F.col("log").cast("string").alias("log"), F.pmod(F.xxhash64("event_id"), F.lit(count)).cast("int").alias("ring"), "ts", F.col("event_id").cast("long").alias("event_id"), "message")
    return rows.groupBy("log", "ring").applyInPandasWithState(_keep(kept), RING, _STATE, "update", GroupStateTimeout.NoTimeout)


def newest(of_rings: DataFrame, log: str, kept: int = KEPT) -> DataFrame:
    """The log's newest lines with their level, from the present state of its rings."""
    mine = of_rings.filter(F.col("log") == log)
    return metadata.log_tail(mine, kept).select("ts", "event_id", "message", log_level("message").alias("level"))
