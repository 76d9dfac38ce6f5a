"""URL rules as a sort-merge range join.

A host is turned around label by label, each label closed by a dot, so that a
host and all its subdomains form one interval of keys. Pages and rules are
dealt into the same key ranges and sorted; one sweep over each range keeps a
stack of the rules whose intervals enclose the current key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many keys, picked by a hash, are looked at to choose the ranges; they only say where ranges begin, all rows are judged.
KEYS_FOR_RANGES = 4096
#: Of a key so many characters are looked at for that.
BOUND_LENGTH = 300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First the text before the first ://, then host and path.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` gives ``com.example.www.``; the empty host gives the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range and key, rules before pages; the stack holds (prefix, {path: rule}) of enclosing hosts."""
    at_range, stack = None, []
    for frame in frames:
        rows = []
        for range_no, key, is_page, row_id, host, path, rule, verdict in frame.itertuples(index=False, name=None):
            if range_no != at_range:
                at_range, stack = range_no, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                stack[-1][1][path] = (rule, verdict)
                continue
            best = (-1, -1, None, None)
            for prefix, paths in stack:
                if len(paths) <= len(path) + 1:
                    fits = [p for p in paths if path.startswith(p)]
                else:
                    fits = [path[:n] for n in range(len(path) + 1) if path[:n] in paths]
                for p in fits:
                    best = max(best, (len(prefix) + len(p), len(prefix), *paths[p]), key=lambda b: b[:2])
            rows.append((row_id, host, path, best[2], best[3]))
        yield pd.DataFrame(rows, columns=["row_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return id_col, host, path, rule and verdict for each page.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains
    if the url's path starts with its path; of those that fit the one with the
    longest host and path together wins, of equal ones the longest host; without
    one the verdict is ``default``. Of repeated rules one stands, a block before
    an allow. Rules with a null or empty host, or a null path, are left out. A null url, or one
    without ://, has an empty host and path, which no rule fits. Repeated pages
    and null ids each give a row; other columns are not read.

    Very long urls are taken whole.

    A host with very many pages, equal ones among them, is spread over several
    ranges by a number of the row; a rule goes to each range that its interval
    meets. Nothing is broadcast; the driver gets at most 4 x KEYS_FOR_RANGES beginnings of keys.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("row_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.hex(F.xxhash64(F.monotonically_increasing_id())).alias("salt"))
    # \x01 sorts below all that a longer host can go on with
    keyed = parts.select("row_id", "host", "path", reversed_host(F.col("host")).alias("key"), "salt").withColumn("place", F.concat("key", F.lit("\x01"), "salt"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, pages.count() // KEYS_FOR_RANGES)
    some = keyed.select(F.substring("place", 1, BOUND_LENGTH).alias("place"), "salt").filter(F.pmod(F.xxhash64(F.lit("ranges"), "salt"), F.lit(every)) == 0)
    picked = sorted(r[0] for r in some.select("place").limit(4 * KEYS_FOR_RANGES).collect())
    bounds = sorted({picked[i * len(picked) // ranges] for i in range(1, ranges)}) if picked else []
    begins = F.array(*map(F.lit, bounds)) if bounds else F.expr("cast(array() as array<string>)")

    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(len(bounds).bit_length(), 1)))])

    def range_of(place: Column) -> Column:
        """The number of bounds up to ``place``, by halving."""
        return F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(begins, low + step - 1) <= place, F.lit(False)), low + step).otherwise(low))

    events = "range_no", "key", "is_page", "row_id", "host", "path", "rule", "verdict"
    page_events = keyed.select(range_of(F.col("place")).alias("range_no"), "key", F.lit(True).alias("is_page"), "row_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    named = rules.filter("host <> '' and path is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    keyed_rules = named.select("path", "verdict", F.concat("host", "path").alias("rule"), reversed_host(F.col("host")).alias("key"))
    # the dot at the end of a key, one up, bounds what starts with the key
    above = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    rule_events = keyed_rules.select(
        F.explode(F.sequence(range_of(F.col("key")), range_of(above))).alias("range_no"), "key", F.lit(False).alias("is_page"), F.lit(None).cast(id_type).alias("row_id"), F.lit(None).cast("string").alias("host"), "path", "rule", "verdict"
    )
    swept = (
        page_events.select(*events)
        .unionByName(rule_events.select(*events))
        .repartition(ranges, "range_no")
        .sortWithinPartitions("range_no", "key", "is_page")
        .mapInPandas(_sweep, f"row_id {id_type}, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("row_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
