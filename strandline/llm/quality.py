"""Quality rules: repetition and symbol counts, and distance from the language's usual distribution.

A document's histograms of character classes and of its language's most common
words are held against the same histograms over all documents of the language,
by the Jensen-Shannon distance (base 2, so 0 to 1). Short documents are not
judged by it: their histograms say little.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import whole, words
from strandline.workspace import materialize

WINDOW = 8
#: Places in a window that are looked at first: a text in which these never occur again together needs no closer look.
SIEVE = (0, 2, 5, 7)
#: Character classes in which a text is counted, next to a-z and what is left over.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "end": r"[.,;:!?]", "symbol": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E&&[^.,;:!?]]"}
COMMON_WORDS = 24
MIN_WORDS = 50
#: A document further than these from its language fails.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
#: Languages whose word lists are sent to all executors at most; more are joined by a shuffle.
SENT_LANGUAGES = 1000
_C = [f"c{i}" for i in range(len(CLASSES) + 2)]
_W = [f"w{i}" for i in range(COMMON_WORDS + 1)]


def window_hash(parts: list[str]) -> str:
    """SQL of the hash by which windows are first compared."""
    return f"xxhash64({', '.join(parts)})"


def _windows(places: Sequence[int], hashed: Callable[[list[str]], str]) -> Column:
    """A number for each window of WINDOW words, from the words at ``places`` in it."""
    return F.expr(f"transform(sequence(0, size(__hashes) - {WINDOW}), i -> {hashed([f'__hashes[i + {k}]' for k in places])})")


def _again(numbers: str) -> Column:
    return F.size(numbers) > F.size(F.array_distinct(numbers))


def _neighbours(rows: str, field: str) -> str:
    """SQL for those of the sorted array ``rows`` that have the same ``field`` as the one before or after them."""
    return f"filter({rows}, (x, i) -> coalesce(get({rows}, i - 1).{field} = x.{field}, false) OR coalesce(get({rows}, i + 1).{field} = x.{field}, false))"


def _repeats(rows: DataFrame, hashed: Callable[[list[str]], str]) -> DataFrame:
    """Add ``n_repeat_words`` from ``__words`` and ``__hashes``: words in windows that are found again in the text.

    Hashes say which windows may be equal; of these the words themselves are
    compared, each with the one before it among those of its hash, and where any
    two differ the windows are put in order by their words.
    """
    rows = rows.withColumn("__sieve", F.when(F.size("__hashes") >= WINDOW, _windows(SIEVE, window_hash)))
    rows = rows.withColumn("__windows", F.when(_again("__sieve"), _windows(range(WINDOW), hashed)))
    numbered = F.expr("transform(__windows, (h, i) -> named_struct('h', h, 'i', i))")
    rows = rows.withColumn("__sorted", F.when(_again("__windows"), F.sort_array(numbered))).withColumn("__likely", F.expr(_neighbours("__sorted", "h")))
    own, before = (f"slice(__words, {x}.i + 1, {WINDOW})" for x in ("x", "get(__likely, i - 1)"))
    rows = rows.withColumn("__differ", F.expr(f"size(filter(__likely, (x, i) -> get(__likely, i - 1).h = x.h AND {own} <> {before}))"))
    rows = rows.withColumn("__worded", F.when(F.col("__differ") > 0, F.sort_array(F.expr(f"transform(__likely, x -> named_struct('w', {own}, 'i', x.i))"))))
    places = F.when(F.col("__differ") > 0, F.expr(f"transform({_neighbours('__worded', 'w')}, x -> x.i)")).otherwise(F.expr("transform(__likely, x -> x.i)"))
    rows = rows.withColumn("__places", F.sort_array(places))
    # each repeat covers WINDOW words, or what lies before the next repeat
    covered = f"aggregate(transform(__places, (x, i) -> least({WINDOW}, coalesce(get(__places, i + 1) - x, {WINDOW}))), 0, (a, b) -> a + b)"
    return rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("__sieve", "__windows", "__sorted", "__likely", "__differ", "__worded", "__places")


def _counts(docs: DataFrame, hashed: Callable[[list[str]], str]) -> DataFrame:
    """The base rule's figures and both histograms of each row of ``docs`` (doc_id, lang, text and common)."""
    text, rest = F.col("__text"), F.col("__rest")
    rows = docs.select("doc_id", "lang", "common", whole("text").alias("__text")).withColumn("__words", words(text))
    # all but a-z and white space: little is left to look for the other classes in
    rows = rows.withColumns({"__rest": F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""), "__lines": F.when(text.contains("\n"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))})
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(rest) - F.length(F.regexp_replace(rest, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": F.coalesce(F.size("__lines") - F.size(F.array_distinct("__lines")), F.lit(0)).cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(F.lower(w))),
    })
    classes = [F.col("word_chars") - F.length(rest), *[F.length(rest) - F.length(F.regexp_replace(rest, f"{chars}+", "")) for chars in CLASSES.values()]]
    counts = [F.coalesce(F.col("n_words") - F.size(F.array_remove("__hashes", F.get("common", F.lit(i)))), F.lit(0)) for i in range(COMMON_WORDS)]
    rows = rows.withColumns({c: n.cast("long") for c, n in zip(_C, classes)} | {w: n.cast("long") for w, n in zip(_W, counts)})
    rows = _repeats(rows.drop("__text", "__lines", "__rest", "common"), hashed)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # the last of each histogram is what belongs nowhere else
    rest_of = lambda total, parts: (F.col(total) - sum((F.col(c) for c in parts[1:-1]), F.col(parts[0]))).alias(parts[-1])
    return rows.select("doc_id", "lang", *figures, *_C[:-1], *_W[:-1], rest_of("word_chars", _C), rest_of("n_words", _W))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common): the most frequent words of each language over all documents, at most COMMON_WORDS.

    Null is a language of its own. Of equally frequent words the first ones count.
    """
    lowered = docs.select("lang", F.lower(whole("text")).alias("__low"))
    # a plain explode has the optimizer test the list's size first, which splits each text a second time
    each = lowered.select("lang", F.explode_outer(words(F.col("__low"))).alias("word")).filter("word is not null")
    counts = materialize(each.groupBy("lang", "word").agg(F.count("*").alias("n")), "quality-vocabulary")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON_WORDS)
    return ranked.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("common"))


def _with_language(rows: DataFrame, right: DataFrame, languages: int) -> DataFrame:
    """``rows`` with the columns of ``right``, one row a language; null is a language like any other."""
    right = right.withColumnRenamed("lang", "__lang")
    return rows.join(F.broadcast(right) if languages <= SENT_LANGUAGES else right, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")


def _distance(own: list[str], total: str, usual: list[str], usual_total: str) -> Column:
    """Jensen-Shannon distance of two histograms, each a list of columns and their sum; null if one of them is empty."""
    share = lambda names, of: F.transform(F.array(*[F.col(c).cast("double") for c in names]), lambda x: x / F.col(of))
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    sums = F.aggregate(F.zip_with(share(own, total), share(usual, usual_total), lambda x, y: term(x, y) + term(y, x)), F.lit(0.0), lambda a, b: a + b)
    return F.when((F.col(total) > 0) & (F.col(usual_total) > 0), F.sqrt(F.greatest(sums / 2, F.lit(0.0))))


def judge(docs: DataFrame, hashed: Callable[[list[str]], str] = window_hash) -> DataFrame:
    """Figures and verdict for each row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the distances class_distance and word_distance, which
    are null for texts without words. A null text has no words; a null language is
    a language of its own, and so is an empty one. Documents under MIN_WORDS words are judged by the base rule alone. Repeated rows
    and null ids each give their row; other columns are not read. Windows of words
    whose hashes (``hashed``) agree are compared word by word; common words are counted by their 64-bit
    hashes alone. References are taken over all rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    lists = materialize(common_words(docs), "quality-words")
    languages = lists.count()
    hashes = lists.withColumn("common", F.transform("common", lambda w: F.xxhash64(w)))
    found = materialize(_counts(_with_language(docs, hashes, languages), hashed), "quality-counts")
    sums = [F.sum(c).alias(f"usual_{c}") for c in ("word_chars", "n_words", *_C, *_W)]
    rows = _with_language(found, found.groupBy("lang").agg(*sums), languages)
    rows = rows.withColumns({
        "class_distance": _distance(_C, "word_chars", [f"usual_{c}" for c in _C], "usual_word_chars"),
        "word_distance": _distance(_W, "n_words", [f"usual_{w}" for w in _W], "usual_n_words"),
    })
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    strange = (F.col("n_words") >= MIN_WORDS) & ((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE))
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*figures, failed.alias("base_failed"), (~failed & ~F.coalesce(strange, F.lit(False))).alias("kept"), "class_distance", "word_distance")
