import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm import preference

TURNS = "pair long, chosen boolean, turn long, role string, text string, prompt string"


def escaped(said):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", said)


def render(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def plain(rows):
    sides = defaultdict(lambda: {True: [], False: []})
    for pair, chosen, turn, role, text, _ in rows:
        if pair is not None and chosen is not None:
            sides[pair][chosen].append((turn is not None, turn or 0, role or "user", text or ""))
    out = {}
    for pair, both in sides.items():
        c, r = ([t[2:] for t in sorted(both[s])] for s in (True, False))
        if not c or not r:
            continue
        n = next((i for i, (x, y) in enumerate(zip(c, r)) if x != y), min(len(c), len(r)))
        c, r = ([tuple(map(escaped, t)) for t in side] for side in (c, r))
        found = [n, "".join(render(*t) for t in c[:n])]
        for side in (c[n:], r[n:]):
            body, mask = "", []
            for role, text in side:
                if role == "assistant":
                    at = len(body) + len(role) + 5
                    mask.append(f"{at}:{at + len(text) + 7}")
                body += render(role, text)
            found += [body, ",".join(mask)]
        out[pair] = tuple(found)
    return out


def test_pairs(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(60)]), rng.choice([True, True, False, False, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "system", "<|end|>"]), rng.choice([None, "", "same", "é\U0001f600", "a <|end|> b", "a <\\|end|> b"]), "x") for _ in range(600)]
    for pair in range(100, 140):  # long common prefixes
        talk = [(i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(rng.randint(1, 12))]
        cut = rng.randint(0, len(talk))
        rows += [(pair, True, *t, "x") for t in talk] + [(pair, False, *t, "x") for t in talk[:cut]] + [(pair, False, i, "assistant", "other", "x") for i in range(cut, cut + rng.randint(0 if cut else 1, 2))]
    rows += [(200, True, 0, "user", "only one side", "x")]
    got = {r.pair: (r.n_common, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.pairs(spark.createDataFrame(rows, TURNS).repartition(4)).collect()}
    assert got == plain(rows)


def test_empty(spark):
    assert preference.pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_turns_that_look_alike_when_escaped(spark):
    rows = [(1, True, 0, "user", "a <| b", "x"), (1, False, 0, "user", "a < | b", "x"), (2, True, 0, "user", "<\\|", "x"), (2, False, 0, "user", "<|", "x")]
    got = {r.pair: r for r in preference.pairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].n_common == got[2].n_common == 0 and got[1].prompt == ""
    said = ["a <| b", "<\\|", "<\\\\| <|", "<", "|", "\\|", "plain"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    both = df.select("s", preference.escape(F.col("s")).alias("e")).withColumn("u", preference.unescape(F.col("e"))).collect()
    assert all(r.s == r.u and "<|" not in r.e for r in both) and len({r.e for r in both}) == len(said)


def test_long_texts_and_conversations(spark):
    talk = [(i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(5000)]
    rows = [(1, True, *t, "x") for t in talk] + [(1, False, *t, "x") for t in talk[:10]] + [(1, False, 10, "assistant", "y" * 300_000, "x")]
    got = {r.pair: (r.n_common, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.pairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == plain(rows)
