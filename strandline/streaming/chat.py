"""Chat events folded into steps: over a table by windows, over a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "chat_id string, step int, kind string, body string, result string"
#: Steps so far, the last one, and tool calls that wait for a result, oldest first.
_STATE = "steps int, kind string, body string, result string, waiting array<struct<step: int, body: string>>"


def chat_steps(events: DataFrame) -> DataFrame:
    """chat_id, step (from 0), kind, body and result of each chat in ``events`` (chat_id, seq, kind, body).

    Neighbouring thinking or text events join up, whatever results come between; a
    tool's result goes to the oldest call without one, and is lost where none waits.
    Null bodies are empty. Windows go through a chat in order; none is ever one row.
    """
    chat = Window.partitionBy("chat_id").orderBy("seq")
    so_far = chat.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.select("chat_id", "seq", "kind", F.coalesce("body", F.lit("")).alias("body"))

    said = rows.filter("kind <> 'tool_result'")
    begins = F.when((F.col("kind") == F.lag("kind").over(chat)) & F.col("kind").isin("thinking", "text"), 0).otherwise(1)
    stepped = said.withColumn("step", F.sum(begins).over(so_far) - 1).withColumn("call", F.count_if(F.col("kind") == "tool_call").over(so_far))
    steps = stepped.groupBy("chat_id", "step", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "").alias("body"),
        F.when(F.col("kind") == "tool_call", F.max("call")).alias("call"),
    )

    # a result is lost whenever there would be more results than calls; the others are numbered as the calls are
    tools = rows.filter("kind in ('tool_call', 'tool_result')").withColumn("is_result", F.col("kind") == "tool_result")
    counted = tools.withColumns({"results": F.count_if("is_result").over(so_far), "calls": F.count_if(~F.col("is_result")).over(so_far)})
    lost = counted.withColumn("lost", F.greatest(F.lit(0), F.max(F.col("results") - F.col("calls")).over(so_far)))
    found = lost.withColumn("before", F.coalesce(F.lag("lost").over(chat), F.lit(0))).filter("is_result AND lost = before")
    results = found.select(F.col("chat_id").alias("of_chat"), (F.col("results") - F.col("lost")).alias("of_call"), F.col("body").alias("result"))
    both = steps.join(results, F.col("chat_id").eqNullSafe(F.col("of_chat")) & (F.col("call") == F.col("of_call")), "left")
    return both.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("step").cast("int").alias("step"), "kind", "body", "result")


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The steps that this batch's events begin or change."""
    events = pd.concat(list(frames)).sort_values("seq")
    count, kind, body, result, waiting = state.get if state.exists else (0, None, None, None, [])
    waiting, changed = [tuple(w) for w in waiting], {}
    for what, text in events[["kind", "body"]].itertuples(index=False, name=None):
        text = text or ""
        if what == "tool_result":
            if waiting:
                step, call = waiting.pop(0)
                changed[step] = ("tool_call", call, text)
                if step == count - 1:
                    result = text
        elif what == kind and what in ("thinking", "text"):
            body += text
            changed[count - 1] = (kind, body, None)
        else:
            count, kind, body, result = count + 1, what, text, None
            changed[count - 1] = (kind, body, result)
            if what == "tool_call":
                waiting.append((count - 1, text))
    state.update((count, kind, body, result, waiting))
    yield pd.DataFrame([(key[0], step, *changed[step]) for step in sorted(changed)], columns=["chat_id", "step", "kind", "body", "result"])


def stream_steps(events: DataFrame) -> DataFrame:
    """``chat_steps`` of a stream: each batch gives the steps that it begins or changes, whole, for an upsert by chat_id and step.

    State holds a chat's last step and the calls that wait, no more; a chat's events
    of later batches follow those of earlier ones.
    """
    rows = events.select(F.col("chat_id").cast("string").alias("chat_id"), "seq", "kind", "body")
    return rows.groupBy("chat_id").applyInPandasWithState(_fold, STEPS, _STATE, "update", GroupStateTimeout.NoTimeout)
