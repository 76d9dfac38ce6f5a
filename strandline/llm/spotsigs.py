"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A run of common words (the anchors) with the CHAIN content words behind it is a
spot signature; a text's fingerprint is the set of its signatures' hashes.
Boilerplate without sentences has few anchors and so leaves few traces. Sets are
compared by Jaccard similarity, pruned by length: lengths fall into partitions so
that only sets of the same or neighbouring ones can reach the least similarity,
and within these the ratio of the lengths bounds it once more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.licenses import license_words
from strandline.llm.text import whole

#: Common words of English, German, French and Spanish, the anchors.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their there they this to was were which will with you "
    "als auch auf aus bei das dass dem den der des die ein eine einen er es für ich ihr im ist mit nicht noch sich sie sind so und von war wie wir zu zum zur "
    "au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cual del el ella entre era esta este fue ha hay las lo los más me mi no o para pero por se si sin sobre su sus una y ya"
).split()
#: Content words in a chain.
CHAIN = 3
#: Similarities that lengths alone keep below this count as none.
LEAST = 0.05
#: Rows meant for one range of ids, keys sampled for each, and at most so many ranges.
_RANGE_ROWS, _SAMPLED, _RANGES = 128, 4, 1 << 16
#: Ends an anchor inside a unit; words hold no such character.
_GLUE = "\x02"


def with_signatures(rows: DataFrame, text: str, name: str, chain: int = CHAIN, anchors: list[str] | tuple[str, ...] = tuple(ANCHORS)) -> DataFrame:
    """Add ``name``, the sorted distinct hashes (16 hex digits each) of the signatures of column ``text``; null as empty.

    Words are runs of anything but ASCII other than letters and digits, in lower
    case. Chains at the end of a text may be shorter. A text without a signature
    but with words has one, of all its words; one without words has none.
    """
    words, split, units, content, found = (f"__{part}_{name}" for part in ("words", "split", "units", "content", "found"))
    # each content word with the anchors before it; what follows the last content word goes
    glued = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(*anchors), _GLUE).otherwise(" "))), "")
    hashed = lambda chain: F.substring(F.md5(chain), 1, 16)
    chains = F.transform(units, lambda u, i: F.when(u.contains(_GLUE), hashed(F.concat_ws(" ", u, *[F.get(content, i + k) for k in range(1, chain)]))))
    of_all = F.array(hashed(F.array_join(words, " ")))
    rows = rows.withColumn(words, license_words(whole(text))).withColumn(split, F.split(glued, " ", -1))
    rows = rows.withColumn(units, F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0))))
    rows = rows.withColumn(content, F.transform(units, lambda u: F.substring_index(u, _GLUE, -1)))
    rows = rows.withColumn(found, F.sort_array(F.array_distinct(F.array_compact(chains))))
    return rows.withColumn(name, F.when((F.size(found) == 0) & (F.size(words) > 0), of_all).otherwise(F.col(found))).drop(words, split, units, content, found)


def likeness(a: str, b: str, least: float = LEAST) -> Column:
    """Jaccard similarity of two signature columns; 0 where their lengths keep it below ``least``.

    Two empty sets are alike, an empty one and another are not. ``least`` is
    above 0 and below 1. Lengths between powers of 1 / ``least`` are a partition;
    sets of partitions that aren't the same or neighbours are never compared.
    """
    n, m = F.size(a), F.size(b)
    step = -math.log(least)
    apart = F.abs(F.floor(F.ln(n.cast("double")) / step) - F.floor(F.ln(m.cast("double")) / step))
    reachable = (apart <= 1) & (F.least(n, m) >= F.greatest(n, m) * F.lit(least))
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).when(reachable, both / (n + m - both)).otherwise(0.0)


def _with_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (with key, doc_id and a hash of the text) once for each range of keys it belongs to, with range and guest.

    The bounds are keys of a sample and decide on the sizes alone. The largest row of
    a range is a guest in the next one, the largest of all in the first, so that each
    row is in one range with the row that follows it.
    """
    found = rows.agg(F.count("*").alias("n"), F.to_json(F.max("key")).alias("top")).first()
    ranges = min(-(-found.n // _RANGE_ROWS), _RANGES)
    bounds = []
    if ranges > 1:
        some = rows.select("key").sample(min(1.0, ranges * _SAMPLED / found.n), seed=1).distinct().orderBy("key").select(F.to_json("key").alias("key"))
        bounds = [r.key for r in some.collect()][_SAMPLED - 1 :: _SAMPLED]  # at most _RANGES or so
    block = max(math.isqrt(len(bounds)), 1)
    blocks = [bounds[i : i + block] for i in range(0, len(bounds), block)]
    listed = lambda parts: "[" + ", ".join(parts) + "]"
    kind = rows.schema["key"].dataType.simpleString()
    lasts, nested, top = (F.from_json(F.lit(text), schema) for text, schema in (
        (listed(b[-1] for b in blocks), f"array<{kind}>"), (listed(map(listed, blocks)), f"array<array<{kind}>>"), (found.top or "{}", kind)))
    none = F.from_json(F.lit("[]"), f"array<{kind}>")
    rows = rows.withColumn("__block", F.size(F.filter(lasts, lambda b: b < F.col("key")))).withColumn("__bounds", F.coalesce(F.get(nested, F.col("__block")), none))
    rows = rows.withColumn("__inner", F.size(F.filter("__bounds", lambda b: b < F.col("key"))))
    number = F.least(F.col("__block") * block + F.col("__inner"), F.lit(len(bounds)))  # the last block may be short
    place = lambda where, guest: F.struct(where.alias("range"), F.lit(guest).alias("guest"))
    places = F.array(place(number, False), F.when(F.get("__bounds", F.col("__inner")) == F.col("key"), place(number + 1, True)), F.when(F.col("key") == top, place(F.lit(0), True)))
    return rows.withColumn("__place", F.explode(F.array_compact(places))).select(*[c for c in rows.columns if not c.startswith("__")], "__place.*")


def compare(docs: DataFrame, chain: int = CHAIN, least: float = LEAST) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, signatures and edited_signatures (sorted
    hashes), near_edited and near_next (``likeness`` of the row's signatures to those
    of its edited text and of the next document's). The next document is that of the
    next smaller doc_id, after the last the first; rows with equal ids follow each
    other by hashes of their texts, null ids come last; a lone row is its own next.
    A null text is empty. In the edited text the next document's first floor(n_chars
    / 2) code points, or all of them, stand for that many at the end. Other columns
    are not read. Texts are shuffled once, by ranges of ids.
    """
    rows = docs.select("doc_id", whole("text").alias("text"))
    placed = _with_ranges(rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h"))))
    in_range = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("key"), "text")
    with_next = placed.withColumn("next", F.lead("text").over(in_range)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    edited_rows = with_next.withColumn("edited", edited).drop("next").withColumn("edited_sha256", F.sha2("edited", 256))
    signed = with_signatures(with_signatures(edited_rows, "edited", "edited_signatures", chain).drop("edited"), "text", "signatures", chain)
    both = signed.withColumn("next", F.lead("signatures").over(in_range)).filter("not guest")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "signatures", "edited_signatures",
        likeness("signatures", "edited_signatures", least).alias("near_edited"), likeness("signatures", "next", least).alias("near_next"),
    )
