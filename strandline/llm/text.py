"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and \\t to \\r.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of anything but white space.

    Where spaces and line breaks are all the white space there is, no regular expression is needed.
    """
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | text.contains(c)
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    return F.array_remove(F.when(other, F.split(text, SPACE, -1)).otherwise(plain), "")


def begins(sizes: str, block: int = 256) -> Column:
    """Where each part begins if parts of ``sizes`` (the name of a column, array of int) are laid end to end.

    Lists grow by copying, so they are built ``block`` parts at a time, each block
    from where it begins: the cost follows the number of parts.
    """
    numbers = f"sequence(b * {block}, least((b + 1) * {block}, size({sizes})) - 1)"
    blocks = f"sequence(0, (size({sizes}) - 1) div {block})"
    totals = f"transform({blocks}, b -> aggregate({numbers}, 0, (s, i) -> s + {sizes}[i]))"
    firsts = f"slice(aggregate({totals}, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x))), 1, (size({sizes}) - 1) div {block} + 1)"
    inside = f"slice(aggregate({numbers}, array(b0), (s, i) -> concat(s, array(element_at(s, -1) + {sizes}[i]))), 1, size({numbers}))"
    return F.expr(f"CASE WHEN size({sizes}) > 0 THEN flatten(transform({firsts}, (b0, b) -> {inside})) ELSE cast(array() as array<int>) END")


#: What the last operator of this Python worker keeps from one task to the next, and what it belongs to.
_KEPT: list[tuple[object, object]] = []


def kept(owner: object, make: Callable[[], object]):
    """What this worker keeps for ``owner``, made if there is none; what it kept for another goes."""
    if not _KEPT or _KEPT[0][0] != owner:
        _KEPT.clear()
        _KEPT.append((owner, make()))
    return _KEPT[0][1]


def release() -> None:
    """What this worker keeps for an operator goes; tasks that need their memory call it first."""
    _KEPT.clear()
