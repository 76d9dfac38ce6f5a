import hashlib
import math
import random
import re
import time
from collections import Counter

from strandline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out, counts = [], []
    for kind, pattern in PLAIN.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest()), out


FIXED = [
    "mail me at jo.doe+x@mail.example.com or a@b.c_d@e.f, a@b.c@d.e x@y",
    "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 256.1.1.1 000000001.2.3.004 1.2.3 12345678901234567890.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 4111111111111111, 5500005555555559.",
    "call +1 (743) 555-3824, +49 30 1234567, +1, +12, +1 ((((((, +123456789012345678",
    "\U0001f600 é x@example.com \U0001f600\U0001f600 10.0.0.1",
    "password = \"abc12345xyz\" token: 0123456789abcdef ssn 123-45-6789 call (555) 123-4567 Dr. Meier, James Smith",
    None, "", "   ", "@", "+", "1", "a" * 30_000, "1" * 30_000, "1 " * 30_000, "a." * 20_000, "+1" * 5000,
]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(6)
    alphabet = ["1", "4", "25", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "_", "é", "\U0001f600"]
    texts = FIXED + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "t") for i, t in enumerate(texts)], "doc_id long, text string, found string").repartition(4)
    for r in pii.detect(df).collect():
        want, spans = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, texts[r.doc_id]
        got = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(got) and r.n_added == len(got) - len(spans)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in got)]
        assert order == sorted(order) and all(int(e) <= len(texts[r.doc_id]) for *_, e in (s.split(":") for s in got))


def test_estimates_and_odd_tables(spark):
    good, bad = [0, 1, 1, 1, 1, 1, 0], [2, -1, -1, -1, -1, 2, 4]
    model = pii.estimate(spark.createDataFrame([(good, 80), (bad, 60), ([0, 1, 1, 0, 1, 1, 0], 20)], "traits array<int>, n long"))
    assert 0.5 < model["prior"] < 0.8 and all(model["trust"][name][1][1] > model["trust"][name][0][1] for name in pii.LABELERS)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(none).count() == 0
    rows = pii.detect(spark.createDataFrame([(None, "x@example.com"), (1, "x@example.com"), (1, "x@example.com")], "doc_id long, text string")).collect()
    assert [r.spans for r in rows] == ["email:0:13"] * 3


def test_very_many_matches(spark):
    """Places stay right over many blocks, and the time follows the number of matches."""
    took = {}
    for n in (20_000, 200_000):
        text = "\u00e9 ".join(f"m{i}@example.com" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.detect(df, rounds=1).first()
        took[n] = time.time() - began
        assert (row.n_email, row.base_sha256) == (n, base(text)[0][4]) and row.private
    assert took[200_000] < 120, took


def test_nothing_is_cut(spark):
    secret, name = "a1" * 400, "Zz" + "y" * 90
    text = f'token = "{secret}" and Dr. {name} said so'
    spans = pii.propose(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    kinds = {pii.KINDS[s.k]: text[s.start : s.stop] for s in spans}
    assert kinds["secret"] == secret and kinds["name"] == f"Dr. {name}"


def plain_model(patterns, rounds):
    """Expectation-maximisation over vote patterns, then naive Bayes on its posteriors."""
    at = {name: pii.FEATURES.index(name) for name in pii.FEATURES}
    prior, trust = 0.5, {name: ({1: 0.2, -1: 0.8}, {1: 0.8, -1: 0.2}) for name in pii.LABELERS}

    def weights():
        out = []
        for traits, n in patterns:
            yes, no = prior, 1 - prior
            for name in pii.LABELERS:
                yes, no = yes * trust[name][1].get(traits[at[name]], 1), no * trust[name][0].get(traits[at[name]], 1)
            out.append(n * yes / (yes + no))
        return out

    def tables(names, values, yes):
        total = sum(n for _, n in patterns)
        share = lambda name, v, side: sum((y if side else n - y) for (t, n), y in zip(patterns, yes) if t[at[name]] == v)
        return {name: tuple({v: (share(name, v, side) + 1) / (sum(share(name, x, side) for x in values[name]) + len(values[name])) for v in values[name]} for side in (0, 1)) for name in names}, (sum(yes) + 1) / (total + 2)

    votes = dict.fromkeys(pii.LABELERS, (1, -1))
    for _ in range(rounds):
        trust, prior = tables(pii.LABELERS, votes, weights())
    values = votes | {"kind": range(len(pii.KINDS)), "long": range(4), "digits": range(5)}
    found, share = tables(pii.FEATURES, values, weights())
    return lambda traits: math.log(share / (1 - share)) + sum(math.log(found[f][1].get(traits[at[f]], 1) / found[f][0].get(traits[at[f]], 1)) for f in pii.FEATURES)


def planted(rng):
    """Texts with added kinds planted in them, with decoys of the same look; (text, true spans)."""
    words = "the house of water stands near people who write letters and read them every day".split()
    filler = lambda: " ".join(rng.choices(words, k=rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    true = [
        lambda: ("ssn", "ssn ", f"{rng.randint(100, 599)}-{digits(2)}-{digits(4)}"),
        lambda: ("secret", rng.choice(["token = ", "password: ", "api_key="]), hexed(rng.randint(24, 40))),
        lambda: ("secret", "we use ", rng.choice(["AKIA" + "".join(rng.choices("ABCDEFGH234567", k=16)), "ghp_" + hexed(36), "sk-" + hexed(32)])),
        lambda: ("name", "signed by ", f"{rng.choice(pii.GIVEN_NAMES)} {rng.choice(['Meier', 'Smith', 'Dupont', 'Garc\u00eda'])}"),
        lambda: ("email", "mail ", f"m{digits(3)}@example.com"),
        lambda: ("phone", "call ", f"+1 ({digits(3)}) 555-{digits(4)}"),
    ]
    decoys = [lambda: ("ssn", "serial ", f"{rng.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"), lambda: ("secret", "version pass: ", rng.choice(["everybody", "thefirstofmay", "untiltomorrow"])), lambda: ("card", "order ", "9" + digits(11))]
    out = []
    for _ in range(400):
        text, spans = filler(), set()
        for _ in range(rng.randint(0, 3)):
            make = rng.choice(true if rng.random() < 0.7 else decoys)
            kind, before, value = make()
            text += " " + before
            if make in true:
                spans.add((kind, len(text), len(text) + len(value)))
            text += value + " " + filler()
        out.append((text, spans))
    return out


def test_additions_against_planted_spans_and_a_plain_model(spark):
    cases = planted(random.Random(31))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(4)
    found = pii.propose(df).collect()
    odds = plain_model(list(Counter(tuple(c.traits) for r in found for c in r.found).items()), 10)
    want = {r.doc_id: {(pii.KINDS[c.k], c.start, c.stop) for c in r.found if c.strict or c.possible and odds(c.traits) > 0} for r in found}
    right = wrong = missed = 0
    for r in pii.detect(df).collect():
        got = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, r.spans.split(",")))}
        assert got == want[r.doc_id]
        own = {s for s in got if s[0] in ("ssn", "secret", "name")}
        true = {s for s in cases[r.doc_id][1] if s[0] in ("ssn", "secret", "name")}
        right, wrong, missed = right + len(own & true), wrong + len(own - true), missed + len(true - own)
    print("added kinds: precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


def held_out(rng):
    """Texts of another make than ``planted``, which no labeler was changed for: other words, names, forms and decoys."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(n):
        body = "4" + digits(n - 2)
        total = sum(int(d) if i % 2 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    lines = [
        lambda: ("name", "Kind regards, ", rng.choice(["Dr. Okafor", "Frau Lindqvist", "Linda Marchetti", "Carlos Iglesias", "Prof Yamada"]), "."),
        lambda: ("email", "Write to ", f"{rng.choice(['a.b', 'sales', 'x+y'])}{digits(2)}@mail.example.org", " today."),
        lambda: ("ssn", "His social security number ", f"{rng.randint(100, 599)}-{digits(2)}-{digits(4)}", " is on file."),
        lambda: ("secret", "export token=", "".join(rng.choices("ABCDEFabcdef0123456789", k=28)), "\n"),
        lambda: ("card", "My visa card ", card(16), " expires soon."),
        lambda: ("phone", "Tel. ", f"+49 30 {digits(4)} {digits(4)}", " until noon."),
        lambda: (None, "Invoice ", digits(13), " was paid."),
        lambda: (None, "In ", f"{rng.randint(1900, 2020)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", " it rained."),
        lambda: (None, "Parts ", f"{digits(4)} {digits(4)} {digits(4)}", " are sold out."),
        lambda: (None, "The ", rng.choice(["password of the day", "secret garden", "token gesture"]), " pleased everybody."),
        lambda: (None, "Nothing to see here, only ", rng.choice(["rain", "Monday Morning", "New York"]), "."),
    ]
    out = []
    for _ in range(500):
        text, spans = "", set()
        for _ in range(rng.randint(1, 4)):
            kind, before, value, after = rng.choice(lines)()
            text += before
            if kind:
                spans.add((kind, len(text), len(text) + len(value)))
            text += value + after + " "
        out.append((text, spans))
    return out


def test_held_out_texts(spark):
    cases = held_out(random.Random(77))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(4)
    right = wrong = missed = 0
    for r in pii.detect(df).collect():
        got = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, r.spans.split(",")))}
        true = cases[r.doc_id][1]
        right, wrong, missed = right + len(got & true), wrong + len(got - true), missed + len(true - got)
        # digits of a phone number are no card
        phones = [s for s in got if s[0] == "phone"]
        assert not [s for s in got if s[0] == "card" and any(p[1] < s[2] and s[1] < p[2] for p in phones)]
    print("held out: precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9
