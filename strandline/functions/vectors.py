"""Vector expressions in double precision, and the offline embedding and rerank score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import as_column


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, though a lambda inside looks at it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null where a vector is null or has no length."""
    a, b = as_column(a), as_column(b)
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column | str) -> Column:
    """The vector at length one; one without length stays."""
    scaled = lambda v: bound(norm(v), lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double"))))
    return bound(as_column(a), scaled)


def hash_embedding(text: Column | str, dimension: int) -> Column:
    """A unit vector from the text's sha256: four bytes a value, going round, scaled to -1..1."""
    value = lambda digest, i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1
    eight = bound(F.sha2(as_column(text), 256), lambda digest: F.array(*[value(digest, i) for i in range(8)]))
    return unit(F.slice(F.flatten(F.array_repeat(eight, -(-dimension // 8))), 1, dimension))


def hash_rerank_score(query: Column | str, document: Column | str) -> Column:
    """Share of equal sha256 bytes, and up to a tenth by the document's own digest; at most 1."""

    def score(of: Column) -> Column:
        q, d = of["q"], of["d"]
        same = F.size(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substr(q, i * 2 + 1, F.lit(2)) == F.substr(d, i * 2 + 1, F.lit(2))))
        return F.least(same / 32.0 + F.conv(F.substring(d, 1, 8), 16, 10).cast("long") % 100 / 1000.0, F.lit(1.0))

    return bound(F.struct(F.sha2(as_column(query), 256).alias("q"), F.sha2(as_column(document), 256).alias("d")), score)


def relevance_percent(similarity: Column | str) -> Column:
    s = as_column(similarity)
    return F.when(s < 0, F.abs(s) * 100).otherwise((1 - s) * 100)


def vector_literal(vector: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(as_column(vector), lambda v: v.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column | str) -> Column:
    return F.from_json(as_column(text), "array<float>")


def image_tokens(pixels: Column | str) -> Column:
    """A token for every 560 pixels, begun ones too; 1000 where the size isn't known."""
    p = as_column(pixels)
    return F.when(p > 0, F.ceil(p / 560)).otherwise(1000).cast("int")
