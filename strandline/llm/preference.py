"""Preference pairs: one prompt, a chosen and a rejected completion, and what of each is trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import begins

#: How a turn is written.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def escape(said: Column) -> Column:
    """No marker begins inside a role or text: between ``<`` and ``|`` comes one backslash more than there was."""
    return F.regexp_replace(said, r"<(\\*)\|", r"<\\$1|")


def unescape(said: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(said, r"<\\(\\*)\|", "<$1|")


def render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(TAIL))


def _mask(turns: str, starts: str) -> Column:
    """start:end of what the assistant says in the completion, end marker included, in code points."""
    head, tail = len(HEAD) + len(MIDDLE), len(TAIL.rstrip("\n"))
    begin = f"{starts}[i] + length(t.role) + {head}"
    spans = f"transform({turns}, (t, i) -> IF(t.role = 'assistant', concat({begin}, ':', {begin} + length(t.text) + {tail}), cast(null as string)))"
    return F.expr(f"array_join({spans}, ',')")


def pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair that has both a chosen and a rejected conversation.

    ``turns`` has pair, chosen (boolean), turn, role and text. Returns pair,
    n_common (turns of the longest common prefix, same role and text), prompt (those
    turns, rendered once), chosen and rejected (the turns that follow), and
    chosen_mask and rejected_mask (start:end of the assistant's parts, comma-joined).
    Turns are compared as they are and escaped when they are rendered. They are
    ordered by turn, nulls first, then role and text; repeated rows are
    turns of their own. A null role counts as ``user``, a null text as empty; a null
    pair or side belongs to no conversation. A conversation that is a prefix of the other has an
    empty completion. One shuffle, by pair; other columns are not read. Long texts and
    conversations are taken whole; the work follows their length.
    """
    spoken = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter("pair is not null and chosen is not null").select("pair", F.struct("chosen", spoken.alias("said")).alias("t"))
    grouped = rows.groupBy("pair").agg(F.collect_list("t").alias("t"))

    def side(chosen: bool) -> Column:
        own = F.transform(F.filter("t", lambda x: x["chosen"] == F.lit(chosen)), lambda x: x["said"])
        return F.transform(F.sort_array(own), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))

    both = grouped.select("pair", side(True).alias("c"), side(False).alias("r")).filter("size(c) > 0 and size(r) > 0")
    shorter = "least(size(c), size(r))"
    both = both.withColumn("n", F.expr(f"coalesce(array_min(filter(sequence(1, {shorter}), i -> c[i - 1] <> r[i - 1])) - 1, {shorter})"))
    safe = lambda turns: F.transform(turns, lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    rest = lambda turns: safe(F.slice(turns, F.col("n") + 1, F.size(turns)))
    cut = both.select("pair", "n", safe(F.slice("c", F.lit(1), F.col("n"))).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    fixed = len(HEAD) + len(MIDDLE) + len(TAIL)
    cut = cut.withColumns({f"{x}_size": F.expr(f"transform({x}, t -> length(t.role) + length(t.text) + {fixed})") for x in ("c", "r")})
    cut = cut.withColumns({f"{x}_at": begins(f"{x}_size") for x in ("c", "r")})
    text = lambda turns: F.array_join(F.transform(turns, render), "")
    return cut.select(
        "pair",
        F.col("n").cast("long").alias("n_common"),
        text("p").alias("prompt"),
        text("c").alias("chosen"),
        text("r").alias("rejected"),
        _mask("c", "c_at").alias("chosen_mask"),
        _mask("r", "r_at").alias("rejected_mask"),
    )
