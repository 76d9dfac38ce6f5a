"""License scans with a positional index of rare words.

Templates are licence lines and whole licence texts, each with a mandatory key
phrase. The index has, for the rarest word (highest inverse document frequency in
the corpus) of each key phrase, the templates it stands in, where, and the places
of each template's other rare words. A document's words that the index knows are
looked up; a document position less a template position says where the template
would begin. There the other rare words' places are intersected with the document,
each up to SLACK words off, so that inserted and dropped words do no harm; what is
absent bounds the score from above and rules most places out. At the rest all words
of the key phrase have to stand in a row; then the template is aligned in order with
the words around, none more than SLACK off its place, and the share of its weight
(summed IDF) that the best alignment finds is its score.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.license_texts import LINES, TEXTS
from strandline.llm.text import LOWER, UPPER, whole

#: What the base rule looks for.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label, text and key phrase of each template.
TEMPLATES = LINES + TEXTS
#: A template of which less is found in order is no label.
MIN_SCORE = 0.3
#: Words by which an alignment may be off the template's places, either way.
SLACK = 8
#: Rare words of each template whose places are intersected, besides its key phrase.
MARKS = 8
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INDEX = "map<string, array<struct<label: string, at: int, key_at: int, key: array<string>, words: array<string>, weights: array<double>, total: double, marks: array<struct<word: string, at: int, weight: double>>>>>"


def license_words(text: Column) -> Column:
    """Words after lower-casing A-Z alone; ``lower`` does that where no other letter turns into one of a to z."""
    lowered = F.when(text.rlike(r"[\x{212A}\x{0130}]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _BREAK, -1), "")


def _spell(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def prepare(templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[dict]:
    """The templates as words, with their key phrases and where these begin."""
    out = []
    for label, text, key in templates:
        tokens, phrase = _spell(text), _spell(key)
        at = next(i for i in range(len(tokens)) if tokens[i : i + len(phrase)] == phrase)
        out.append({"label": label, "words": tokens, "key": phrase, "key_at": at})
    return out


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many rows of ``words`` each licence word stands, and the number of rows; one small sum a word."""
    own = F.array(*map(F.lit, vocabulary))
    found = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", own))).alias("word"))
    counts = dict(found.groupBy("word").count().collect())
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def index(templates: list[dict], idf: dict[str, float]) -> Column:
    """The postings: for the rarest word of each key phrase the templates with its place in them and the places of their rare words."""
    postings: dict[str, list[dict]] = {}
    for t in templates:
        word = max(t["key"], key=lambda w: (idf[w], w))
        weights = [idf[w] for w in t["words"]]
        in_key = range(t["key_at"], t["key_at"] + len(t["key"]))
        places = sorted((at for at in range(len(weights)) if at not in in_key), key=lambda at: (-weights[at], t["words"][at], at))[:MARKS]
        marks = [{"word": t["words"][at], "at": at, "weight": weights[at]} for at in places]
        postings.setdefault(word, []).append(t | {"at": t["key_at"] + t["key"].index(word), "weights": weights, "total": sum(weights), "marks": marks})
    return F.from_json(F.lit(json.dumps(postings)), _INDEX)


def _alignment(begin: str, slack: int = SLACK) -> str:
    """The weight that the best alignment of template ``t`` with ``words`` from ``begin`` on finds.

    One number for each way of being off, ``slack`` before to ``slack`` behind the
    place: the best alignment of the template so far with the words up to there.
    """
    last = 2 * slack
    found = f"IF(get(words, {begin} + p - {slack} + k) <=> t.words[p], t.weights[p], 0D)"
    taken = f"transform(sequence(0, {last}), k -> greatest(f[least(k + 1, {last})], f[k] + {found}))"
    step = f"transform(array({taken}), c -> transform(sequence(0, {last}), k -> array_max(slice(c, 1, k + 1))))[0]"
    return f"aggregate(sequence(0, size(t.words) - 1), array_repeat(0D, {last + 1}), (f, p) -> {step}, f -> f[{last}])"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """Licence labels of each row of ``docs`` (doc_id, text) by ``templates`` (label, text, key phrase).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score (the best template's, 0 without one). A null or empty text has no words;
    label lists are then empty strings and the places null. Repeated rows and null
    ids each give their row; other columns are not read. Words inserted, dropped or
    changed outside the key phrase cost their weight alone as long as they put the
    rest no more than SLACK words off. Document frequencies are taken over all rows;
    ties in rarity go by the word. No row is shuffled; the templates' words with
    their frequencies reach the driver and, as the index, all tasks.
    """
    prepared = prepare(templates)
    vocabulary = sorted({w for t in prepared for w in t["words"]} | {w for p in PHRASES.values() for w in _spell(p)})
    rows = docs.select("doc_id", license_words(whole("text")).alias("words"))
    frequency, total = document_frequencies(rows, vocabulary)
    idf = {w: math.log((total + 1) / (n + 1)) + 1e-6 for w, n in frequency.items()}
    rarest = lambda phrase: max(phrase, key=lambda w: (idf[w], w))

    # each document's words that the index or a base phrase is looked up by, with their places
    phrases = {label: _spell(p) for label, p in PHRASES.items()}
    looked_up = sorted({rarest(p) for p in (*phrases.values(), *(t["key"] for t in prepared))})
    rows = rows.withColumn("rare", F.array_intersect(F.array(*map(F.lit, looked_up)), "words"))
    occurs = "filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(rare, x.w))"
    rows = rows.withColumn("hits", F.when(F.size("rare") > 0, F.expr(occurs)))

    found = {}
    for label, phrase in phrases.items():
        at = phrase.index(rarest(phrase))
        same = " AND ".join(f"get(words, x.i + {k - at}) <=> '{w}'" for k, w in enumerate(phrase))
        found[f"b_{label}"] = F.expr(f"transform(filter(hits, x -> {same}), x -> x.i - {at})")
    # a template begins at h.i - t.at
    begin = "(h.i - t.at)"
    near = f"slice(words, greatest({begin} + m.at - {SLACK}, 0) + 1, greatest({begin} + m.at + {SLACK} + 1 - greatest({begin} + m.at - {SLACK}, 0), 0))"
    reachable = f"t.total - aggregate(t.marks, 0D, (s, m) -> s + IF(array_contains({near}, m.word), 0D, m.weight)) >= {MIN_SCORE!r}D * t.total - 1e-9D"
    stands = f"{begin} + t.key_at >= 0 AND slice(words, {begin} + t.key_at + 1, size(t.key)) = t.key"
    verified = f"transform(filter(coalesce(element_at(postings, h.w), array()), t -> {stands} AND {reachable}), t -> named_struct('label', t.label, 'score', {_alignment(begin)} / t.total))"
    rows = rows.withColumn("postings", index(prepared, idf))
    rows = rows.withColumns(found | {"own": F.expr(f"filter(flatten(transform(hits, h -> {verified})), m -> m.score >= {MIN_SCORE!r}D)")})

    none = F.expr("cast(array() as array<int>)")
    base = F.concat(*[F.coalesce(F.col(f"b_{label}"), none) for label in PHRASES])
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.coalesce(F.col(f"b_{label}"), none)) > 0, label) for label in PHRASES]))
    own_labels = F.coalesce(F.transform("own", lambda m: m["label"]), F.expr("cast(array() as array<string>)"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("own", lambda m: m["score"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
