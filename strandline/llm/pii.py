"""Personal data by weak supervision.

Patterns propose spans; four labelers (form, gazetteer, context, border) vote for
or against each or abstain. Expectation-maximisation over the counts of vote
patterns estimates how far each labeler can be trusted, without any labelled
span; its posteriors then train a naive Bayes classifier on the votes and on the
span's kind, length and make-up, which decides about every proposed span that can be
of its kind. Spans that meet the strict rules of their kind stay whatever it says.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import begins, whole
from strandline.workspace import materialize

KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "name")
#: The kinds whose strict matches always stay.
STRICT = KINDS[:4]
LABELERS = ("form", "gazetteer", "context", "border")
FEATURES = ("kind", *LABELERS, "long", "digits")
CONTEXT = 24

#: Common given names and forms of address.
GIVEN_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Hans Peter Klaus Ursula Sabine Pierre Jean Marie Claire Juan Carlos José Luis María Carmen Ana".split()
ADDRESS = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
#: Common top-level domains, beginnings of card numbers and of dialling codes.
DOMAINS = "com org net edu gov info io de fr es it uk eu at ch us ca".split()
CARD_BEGINS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
DIAL_BEGINS = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words before a span that speak for its kind, and for none.
SPEAKS_FOR = {
    "email": r"mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|addr|host|server|client|from",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|ruf|llam|appel",
    "ssn": r"ssn|social|security",
    "secret": r"pass|token|secret|key",
    "name": r"name|author|by|from|dear|contact|signed",
}
#: How keys of well-known services begin, and what follows.
KEY_SHAPES = "AKIA[0-9A-Z]{16} gh[opsur]_[A-Za-z0-9]{30,}+ github_pat_[A-Za-z0-9_]{30,}+ sk-[A-Za-z0-9_-]{20,}+ xox[abprs]-[A-Za-z0-9-]{10,}+ AIza[0-9A-Za-z_-]{35} eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+".split()
SPEAKS_AGAINST = r"version|isbn|order|invoice|serial|page|figure|table|chapter|section|vol"

#: kind, pattern, cheap test. The strict ones find what their plain forms in the contract find; the
#: possessive forms and look-behinds only keep long runs from being tried again from each of their characters.
_PROPOSERS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("phone", r"(?=[(0-9])(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-]{0,2})\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", None),
    ("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("secret", rf"(?<![A-Za-z0-9_-])(?:{'|'.join(KEY_SHAPES)})(?![A-Za-z0-9])|(?<=(?:pass|password|passwd|token|secret|api_key|apikey)\s{{0,2}}[=:]\s{{0,2}}[\"']?)[A-Za-z0-9+/_-]{{8,}}+", None),
    ("name", rf"(?=[A-Z])(?<!\p{{L}})(?:(?:{'|'.join(ADDRESS)})\.?|(?:{'|'.join(GIVEN_NAMES)})) \p{{Lu}}\p{{L}}++", None),
)
_DIGITS = {"card", "phone", "ssn", "ip"}


def _found(at: int) -> Column:
    """The matches of proposer ``at`` with their places in code points, from m<at>, the pieces around them p<at> and where each of these begins, b<at>."""
    none = F.expr("cast(array() as array<struct<start:int,match:string,left:string,right:string>>)")
    m, p, b = F.col(f"m{at}"), F.col(f"p{at}"), F.col(f"b{at}")
    # side by side, so that no list is made again for each match; after the last match there is a piece more
    beside = F.zip_with(F.zip_with(m, b, lambda x, y: F.struct(x.alias("m"), y.alias("b"))), F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.struct(x.alias("l"), y.alias("r"))), lambda x, y: F.struct(x["m"].alias("m"), x["b"].alias("b"), y["l"].alias("l"), y["r"].alias("r")))
    found = F.transform(F.slice(beside, F.lit(1), F.size(m)), lambda x: F.struct((x["b"] + F.length(x["l"])).alias("start"), x["m"].alias("match"), F.right(x["l"], F.lit(CONTEXT)).alias("left"), F.left(x["r"], F.lit(1)).alias("right")))
    return F.coalesce(found, none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _strict(kind: str, match: Column) -> Column:
    """Whether a match meets the strict rules of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return match.startswith("+") & n.between(8, 15)
    return F.lit(False)


def _possible(kind: str, c: Column) -> Column:
    """Whether a match that isn't strict can be of its kind at all: a card's digits have a check digit and stand in no phone number."""
    if kind == "card":
        n = F.length(_digits(c["match"]))
        of_phone = c["left"].rlike(r"\+[0-9\x20().-]*$")
        return F.when(n.between(12, 19) & ~of_phone, _luhn(_digits(c["match"]))).otherwise(False)
    return F.lit(True)


def _sign(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def _votes(kind: str, c: Column) -> dict[str, Column]:
    match, left, right = c["match"], F.lower(c["left"]), c["right"]
    never = F.lit(False)
    form = {
        "ssn": _sign(~match.rlike("^(000|666|9)"), F.lit(True)),
        "secret": _sign(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), match.rlike("^[a-z]+$")),
        "name": F.lit(0),
        "phone": F.when(match.startswith("+"), _sign(_strict(kind, match), F.lit(True))).otherwise(0),
    }.get(kind, _sign(_strict(kind, match), F.lit(True)))
    gazetteer = {
        "email": _sign(F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), F.lit(True)),
        "ip": _sign(~match.rlike(r"^(0|10|127|192\.168|22[4-9]|2[3-5][0-9])\."), never),
        "card": _sign(match.rlike(CARD_BEGINS), F.lit(True)),
        "phone": _sign(match.rlike(DIAL_BEGINS) | match.rlike(r"^\(?[2-9]"), F.lit(True)),
        "secret": _sign(match.rlike(f"^(?:{'|'.join(KEY_SHAPES)})$"), match.rlike("^[A-Z]?[a-z]+$")),
        "name": _sign(F.split(match, r"\.? ")[0].isin(GIVEN_NAMES), never),
    }.get(kind, F.lit(0))
    context = _sign(left.rlike(SPEAKS_FOR[kind]), left.rlike(SPEAKS_AGAINST))
    inside = F.right(left, F.lit(1)).rlike(r"[\p{L}\p{N}_]") | right.rlike(r"[\p{L}\p{N}_]")
    return {"form": form, "gazetteer": gazetteer, "context": context, "border": _sign(~inside, inside)}


def _candidates(kind: str) -> Callable[[Column], Column]:
    return lambda match: _candidate(kind, match)


def _candidate(kind: str, c: Column) -> Column:
    share = F.length(_digits(c["match"])) * 4 / F.length(c["match"])
    size = F.length(c["match"])
    traits = {"kind": F.lit(KINDS.index(kind))} | _votes(kind, c)
    traits |= {"long": F.when(size < 10, 0).when(size < 16, 1).when(size < 20, 2).otherwise(3), "digits": F.floor(share).cast("int")}
    return F.struct(
        F.lit(KINDS.index(kind)).alias("k"), c["start"].alias("start"), (c["start"] + size).alias("stop"), _strict(kind, c["match"]).alias("strict"), _possible(kind, c).alias("possible"), F.array(*[traits[f].cast("int") for f in FEATURES]).alias("traits")
    )


def propose(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``found``: the proposed spans of each text with strictness, votes and features."""
    text = F.col("__text")
    rows = docs.select(*keep, whole("text").alias("__text")).withColumn("__digit", text.rlike("[0-9]"))
    some, pieces = {}, {}
    for at, (kind, pattern, sign) in enumerate(_PROPOSERS):
        test = text.contains(sign) if sign else F.lit(True)
        test = F.col("__digit") & test if kind in _DIGITS else test
        some[f"m{at}"] = F.when(test, F.regexp_extract_all(text, F.lit(pattern), 0))
        # split, a second search, only where there is a match
        pieces[f"p{at}"] = F.when(F.size(f"m{at}") > 0, F.split(text, pattern, -1))
    rows = rows.withColumns(some).withColumns(pieces).withColumns({f"m{at}": F.when(F.size(f"m{at}") > 0, F.col(f"m{at}")) for at in range(len(_PROPOSERS))}).drop("__text", "__digit")
    rows = rows.withColumns({f"s{at}": F.expr(f"transform(m{at}, (x, i) -> length(p{at}[i]) + length(x))") for at in range(len(_PROPOSERS))})
    rows = rows.withColumns({f"b{at}": F.when(F.col(f"s{at}").isNotNull(), begins(f"s{at}")) for at in range(len(_PROPOSERS))})
    rows = rows.withColumns({f"f{at}": _found(at) for at in range(len(_PROPOSERS))})
    lists = [F.transform(f"f{at}", _candidates(kind)) for at, (kind, *_) in enumerate(_PROPOSERS)]
    return rows.select(*keep, F.concat(*lists).alias("found"))


def estimate(patterns: DataFrame, rounds: int = 10) -> dict:
    """Labelers' reliabilities by expectation-maximisation, then the classifier's tables.

    ``patterns`` has traits and n: one row for each combination that occurs, so it
    is bounded by the number of votes and feature values, not by the documents.
    A labeler that abstains says nothing either way, so kinds on which one never
    votes are not told apart by that. Each round is one aggregate over the rows;
    the driver sees only the sums.
    """
    votes = {name: F.col("traits")[FEATURES.index(name)] for name in LABELERS}
    prior = 0.5
    trust = {name: {1: {1: 0.8, -1: 0.2}, 0: {1: 0.2, -1: 0.8}} for name in LABELERS}

    def posterior() -> Column:
        odds = F.lit(math.log(prior / (1 - prior)))
        for name, vote in votes.items():
            step = F.lit(0.0)
            for v in (1, -1):
                step = F.when(vote == v, math.log(trust[name][1][v] / trust[name][0][v])).otherwise(step)
            odds = odds + step
        return 1 / (1 + F.exp(-odds))

    def sums(keys: dict[str, Column], values: dict[str, tuple[int, ...]]):
        """Smoothed weight of each value of each key among true and false spans, and the share of true ones."""
        weighed = patterns.withColumn("yes", F.col("n") * posterior())
        sides = {1: F.col("yes"), 0: F.col("n") - F.col("yes")}
        wanted = [F.sum(F.when(keys[k] == v, side).otherwise(0.0)).alias(f"{k}/{v}/{y}") for k in keys for v in values[k] for y, side in sides.items()]
        row = weighed.agg(F.sum("yes").alias("yes"), F.sum("n").alias("all"), *wanted).first()
        if not row["all"]:
            return None
        weight = lambda k, y: sum(row[f"{k}/{v}/{y}"] for v in values[k])
        tables = {k: {y: {v: (row[f"{k}/{v}/{y}"] + 1.0) / (weight(k, y) + len(values[k])) for v in values[k]} for y in (1, 0)} for k in keys}
        return tables, (row["yes"] + 1.0) / (row["all"] + 2.0)

    for _ in range(rounds):
        if (found := sums(votes, dict.fromkeys(LABELERS, (1, -1)))) is None:
            break
        trust, prior = found
    features = {name: F.col("traits")[i] for i, name in enumerate(FEATURES)}
    values = dict.fromkeys(LABELERS, (1, -1)) | {"kind": tuple(range(len(KINDS))), "long": (0, 1, 2, 3), "digits": (0, 1, 2, 3, 4)}
    trained = sums(features, values)
    return {"prior": trained[1], "tables": trained[0], "trust": trust} if trained else {"prior": prior, "tables": {}, "trust": trust}


def _odds(model: dict, traits: Column) -> Column:
    """log odds of the classifier for a span's features."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for i, name in enumerate(FEATURES):
        if table := model["tables"].get(name):
            low = min(table[1])
            steps = F.array(*[F.lit(math.log(table[1][v] / table[0][v]) if v in table[1] else 0.0) for v in range(low, max(table[1]) + 1)])
            odds = odds + F.get(steps, traits[i] - low)
    return odds


def detect(docs: DataFrame, rounds: int = 10) -> DataFrame:
    """Spans of personal data in each whole text: one row for each row of ``docs``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (over the strict
    spans), spans (strict ones and those that the classifier adds, as
    kind:start:end by kind, then start, in code points), n_added and private
    (whether there is any span). A null or
    empty text has no spans; repeated rows and null ids each give their row; other
    columns are not read. Fitted on all rows; only sums over vote patterns reach
    the driver, and no row is shuffled.
    """
    found = materialize(propose(docs), "pii-found")
    patterns = found.select(F.explode("found").alias("c")).groupBy(F.col("c.traits").alias("traits")).agg(F.count("*").alias("n"))
    model = estimate(materialize(patterns.coalesce(1), "pii-patterns"), rounds)
    listed = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(F.filter("found", lambda c: c["strict"] | (c["possible"] & (_odds(model, c["traits"]) > 0))), lambda c: F.struct(c["k"], c["start"], c["stop"], c["strict"])))
    named = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(listed, c["k"]), c["start"].cast("string"), c["stop"].cast("string"))), ",")
    base = F.filter("kept", lambda c: c["strict"])
    of_kind = F.transform(base, lambda c: c["k"])
    counts = [F.size(F.filter(of_kind, lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(STRICT)]
    return found.select("doc_id", ordered.alias("kept")).select(
        "doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("kept")).alias("spans"), (F.size("kept") - F.size(base)).cast("long").alias("n_added"), (F.size("kept") > 0).alias("private")
    )
