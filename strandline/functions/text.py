"""Text expressions: tokens, sentences, keywords, previews, log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword query leaves out, and what is trimmed from its words.
STOP_WORDS = "the a an and or but in on at to for of with by is are was were be been".split()
WORD_EDGES = ".,!?;:()[]{}\"'"
#: Fixed value: Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A sentence ends at . ! or ? before a space or the end; line ends count as ". ".
SENTENCE = r"(?s).*?[.!?](?: |\z)|.+\z"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def token_estimate(text: Column | str) -> Column:
    """A token for every three bytes, rounded to the nearest: (bytes + 2) div 3."""
    return F.floor((F.octet_length(as_column(text)) + 2) / 3).cast("int")


def trim_space(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def clean_text(text: Column | str) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(as_column(text), r"(?U)\s+", " "))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences, none empty; the trimmed text itself where there are none."""
    whole = F.replace(as_column(text), F.lit("\n"), F.lit(". "))
    found = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(SENTENCE), 0), trim_space), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(trim_space(whole)))


def keywords(query: str) -> list[str]:
    """The words of a query that count, lower-cased and in order; at least two bytes long, no stop words."""
    words = (w.strip(WORD_EDGES) for w in query.lower().split())
    return [w for w in words if len(w.encode()) >= 2 and w not in STOP_WORDS]


def keyword_column(query: Column | str) -> Column:
    """``keywords`` over a column of queries."""
    edges = r"[.,!?;:()\[\]{}\"']+"
    words = F.transform(F.split(F.lower(as_column(query)), r"(?U)\s+"), lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", ""))
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def keyword_weight(word: str) -> float:
    """Half a point for each byte beyond the second, from 1 to 5, in hundredths."""
    return round(min(max(1.0 + (len(word.encode()) - 2) * 0.5, 1.0), 5.0), 2)


def term_frequency(content: Column, word: str) -> Column:
    """How often ``word`` stands in lower-cased content, as a substring and without overlaps."""
    low = F.lower(content)
    return (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / F.length(F.lit(word))


def relevance(content: Column | str, words: list[str]) -> Column:
    total = F.lit(0.0)
    for word in words:
        total = total + term_frequency(as_column(content), word) * F.lit(keyword_weight(word))
    return total


def contains_all(content: Column | str, words: list[str]) -> Column:
    """Every word somewhere in the content, case aside; % and _ in a word match as in LIKE."""
    test = F.lit(True)
    for word in words:
        test = test & F.lower(as_column(content)).like("%" + word.replace("\\", "\\\\") + "%")
    return test


def first_bytes(text: Column | str, size: int, more: Column | str) -> Column:
    """The first ``size`` bytes as text, with ``more`` behind them if that isn't all.

    A character that the cut goes through is left out; bytes that are no UTF-8 become U+FFFD.
    """
    whole = F.make_valid_utf8(as_column(text))
    data = F.encode(whole, "UTF-8")
    head = F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, size - less).cast("string")) for less in range(4)])
    return F.when(F.octet_length(whole) > size, F.concat(head, F.lit(more) if isinstance(more, str) else more)).otherwise(whole)


def preview(text: Column | str, size: int = 500) -> Column:
    return first_bytes(text, size, "...")


def read_head(text: Column | str, size: int = 50 * 1024, total: Column | None = None) -> Column:
    """What the file reader returns: the first 50 KB and a notice; ``total`` are the file's bytes where the text is its beginning alone."""
    # fixed value: the notice
    return first_bytes(text, size, F.concat(F.lit("\n\n[truncated — file is "), F.octet_length(as_column(text)) if total is None else total, F.lit(f" bytes, showing first {size} bytes]")))


def argument_preview(text: Column | str) -> Column:
    whole = as_column(text)
    return F.when(F.length(whole) > 60, F.concat(F.substring(whole, 1, 57), F.lit("..."))).otherwise(whole)


def mask_secret(text: Column | str) -> Column:
    """Four stars and the last four characters; nothing of a shorter one."""
    whole = as_column(text)
    return F.when(F.coalesce(F.length(whole), F.lit(0)) == 0, "").when(F.length(whole) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(whole, F.lit(4))))


def log_level(message: Column | str) -> Column:
    """The first rule that fits, from warning over error and success to info."""
    text = as_column(message)
    low = F.lower(text)
    has = lambda where, *parts: F.coalesce(*[F.when(where.contains(p), True) for p in parts], F.lit(False))
    return (
        F.when(has(text, "⚠️") | has(low, "warn"), "warning")
        .when(has(text, "❌") | has(low, "error", "failed", "panic"), "error")
        .when(has(text, "✅", "✓") | has(low, "completed"), "success")
        .otherwise("info")
    )


def plain_base64(data: Column | str) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(as_column(data)), r"[\r\n]", "")


def sse_events(stream: Column | str) -> Column:
    """The JSON texts of the lines that start with ``data: ``; malformed ones are left out."""
    lines = F.filter(F.split(as_column(stream), "\n"), lambda line: line.startswith("data: "))
    bodies = F.transform(lines, lambda line: F.substring(line, 7, 1 << 30))
    return F.filter(bodies, lambda body: F.get_json_object(body, "$").isNotNull())


def line_count(text: Column | str) -> Column:
    return F.size(F.split(as_column(text), "\n"))


def processed_files(text: Column | str) -> Column:
    """The number in ``processed N files``; null without one."""
    return F.regexp_extract(as_column(text), r"processed\s+(\d+)\s+files?", 1).try_cast("int")
