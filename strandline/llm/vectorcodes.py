"""Vector codes: product quantization in whole numbers with partial-distance search.

A vector is cut into equal parts, each coded by the nearest of its codebook's
entries. The search takes a part's dimensions by descending variance of the
codebook, so that distances grow early; an entry goes as soon as its distance
so far is strictly greater than the least complete distance known, hence ties
stay and go to the lower index. Nothing is rounded, so every run agrees.

Codebooks are fitted in rounds: tasks assign their parts and sum them by entry,
one small row an entry and part goes on, and the driver divides these sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.workspace import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are searched together.
_TOGETHER = 4096
#: Components up to this size have distances within 64 bits; larger ones are reckoned as Python's whole numbers.
_SAFE = 1 << 26
#: At most so many labels are told to all tasks: those with at least this share of the rows.
_HOT_SHARE = 1000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]`` is a list of components; every part has equally many."""

    entries: list[list[list[int]]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as 64-bit numbers where squares of differences fit, else as Python's."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * SCALE)
    if not floors.size or np.abs(floors).max() <= _SAFE:
        return floors.astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of ``entries`` to each row of ``parts``; ties go to the lower index."""
    count, width = parts.shape
    if not width or not count:
        return np.zeros(count, np.int64), np.zeros(count, parts.dtype)
    if object in (parts.dtype, entries.dtype) or np.abs(entries).max() > _SAFE:
        parts, entries = parts.astype(object), entries.astype(object)
    spread = len(entries) * (entries * entries).sum(axis=0) - entries.sum(axis=0) ** 2
    order = np.argsort(-spread, kind="stable")
    first = parts[:, order[0], None] - entries[None, :, order[0]]
    so_far = first * first
    # the entry nearest in the first dimension gives the first complete distance
    gap = parts - entries[so_far.argmin(axis=1)]
    best = (gap * gap).sum(axis=1)
    live = so_far <= best[:, None]
    rows, index = np.nonzero(live)
    so_far = so_far[live]
    for dimension in order[1:]:
        gap = parts[rows, dimension] - entries[index, dimension]
        so_far = so_far + gap * gap
        stay = so_far <= best[rows]
        rows, index, so_far = rows[stay], index[stay], so_far[stay]
    begins = np.flatnonzero(np.diff(rows, prepend=-1))  # a row's first entry stays at least, entries ascend
    least = np.minimum.reduceat(so_far, begins)
    hits = np.flatnonzero(so_far == least[rows])
    firsts = hits[np.flatnonzero(np.diff(rows[hits], prepend=-1))]
    return index[firsts], least


def assign(vectors: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part number, the parts themselves, their indices and distances."""
    width = vectors.shape[1] // len(books)
    for at, entries in enumerate(books):
        part = vectors[:, at * width : (at + 1) * width]
        found = [nearest(part[i : i + _TOGETHER], entries) for i in range(0, len(part), _TOGETHER)]
        yield at, part, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _kept(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite components, and these rows as whole numbers, ``width`` each (zeros at the end)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # without null rows; null components are NaN here
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[owner[~np.isfinite(values)]] = False
    if sizes[good].max(initial=0) > width:
        raise ValueError("a vector is longer than the codebooks' entries together")
    place = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owner]
    taken = good[owner]
    out = np.zeros((len(sizes), width))
    out[owner[taken], place[taken]] = values[taken]
    return good, whole_numbers(out[good])


def _plain(rows: DataFrame, vector: str, *others: Column | str) -> DataFrame:
    return rows.select(F.col(vector).cast("array<double>").alias("__vector"), *others)


def _width(rows: DataFrame, vector: str, parts: int) -> int:
    """The longest kept vector's length, rounded up to a multiple of ``parts``."""
    finite = F.forall("__vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    longest = _plain(rows, vector).filter(finite).agg(F.max(F.size("__vector"))).first()[0] or 0
    return -(-longest // parts) * parts


def initial(rows: DataFrame, vector: str, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the first ``entries`` kept vectors by vec_id; ties by the vector, null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, _ = _kept(batch.column(0), width)
            yield batch.filter(pa.array(good))

    plain = _plain(rows, vector, "vec_id")
    # each task passes on its least rows only
    least = plain.mapInArrow(run, plain.schema).orderBy(F.asc_nulls_last("vec_id"), "__vector").limit(entries)
    found = [v for v, _ in least.collect()]
    table = np.array([v + [0.0] * (width - len(v)) for v in found], np.float64).reshape(len(found), width)
    numbers = whole_numbers(table)
    step = width // parts
    return [numbers[:, p * step : (p + 1) * step] for p in range(parts)]


def refine(rows: DataFrame, vector: str, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the componentwise floor of the mean of its parts; an entry without parts stays."""
    parts, entries, step = len(books), *books[0].shape
    told = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, step), dtype=object)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, vectors = _kept(batch.column(0), parts * step)
            for at, part, index, _ in assign(vectors, told.value) if len(vectors) else ():
                order = np.argsort(index, kind="stable")
                used, begins, n = np.unique(index[order], return_index=True, return_counts=True)
                counts[at, used] += n
                sums[at, used] += np.add.reduceat(part[order], begins, axis=0).astype(object)
        part, entry = np.nonzero(counts)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array([[str(x) for x in row] for row in sums[part, entry]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    partial = _plain(rows, vector).mapInArrow(run, "part int, entry int, n long, sums array<string>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38, 0)")).alias(f"s{i}") for i in range(step)]
    new = [book.astype(object) for book in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows
        new[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(step)]
    return [narrowed(book) for book in new]


def narrowed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or max(map(abs, book.ravel().tolist())) <= _SAFE else book


def fit(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for ``rows`` (vec_id and ``vector``, an array of numbers), which are read once more than there are rounds.

    Null vectors and those with null, NaN or infinite components are left out.
    Vectors count as filled up with zeros to the longest one's length, rounded up
    to a multiple of ``parts``. With fewer vectors than ``entries`` each codebook
    has as many entries as there are vectors; an empty table has empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    width = _width(rows, vector, parts)
    books = initial(rows, vector, width, parts, entries)
    for _ in range(rounds if len(books[0]) and width else 0):
        books = refine(rows, vector, books)
    return Codebooks([[[int(x) for x in entry] for entry in book] for book in books])


def encode(rows: DataFrame, codebooks: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep``, code (two hex digits a part) and error (long) of each row with a vector that ``fit`` would take.

    Null and repeated ids each keep their row. Distances beyond a long end the
    run with an overflow. No shuffle.
    """
    parts = len(codebooks.entries)
    step = len(codebooks.entries[0][0]) if codebooks.entries[0] else 0
    books = [narrowed(np.array(part, dtype=object).reshape(len(part), step)) for part in codebooks.entries]
    told = rows.sparkSession.sparkContext.broadcast(books)
    plain = _plain(rows, vector, *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors = _kept(batch.column(0), parts * step)
            codes, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), vectors.dtype)
            for at, _, index, distance in assign(vectors, told.value) if len(vectors) else ():
                codes[:, at] = index
                error = error + distance
            text = codes.tobytes().hex()
            spelled = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            others = batch.filter(pa.array(good))
            columns = [others.column(i) for i in range(1, batch.num_columns)] + [spelled, pa.array(error.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others.schema.names[1:], "code", "error"])

    out = plain.drop("__vector").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
    coded = plain.mapInArrow(run, out.schema)
    return coded.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def with_group_error(coded: DataFrame, group: str = "label") -> DataFrame:
    """Add label_error, the sum of error over the rows with the same ``group`` (nulls together).

    Sums are combined before the shuffle. Groups with one in _HOT_SHARE of the rows
    or more, at most so many, are told to all tasks; rows of the others find theirs
    in a join that no hot group takes part in.
    """
    coded = materialize(coded, "vector-codes")
    totals = materialize(coded.groupBy(F.col(group).alias("__group")).agg(F.sum("error").alias("__total"), F.count("*").alias("__n")), "vector-totals")
    total = totals.agg(F.sum("__n")).first()[0] or 0
    often = F.col("__n") * _HOT_SHARE >= total
    hot = F.broadcast(totals.filter(often).select(F.col("__group").alias("__hot"), F.col("__total").alias("__hot_total")))
    cold = totals.filter(~often).select("__group", "__total", F.lit(0).alias("__cold_salt"))
    seen = coded.join(hot, F.col(group).eqNullSafe(F.col("__hot")), "left")
    # rows whose sum is known are dealt out among salts that no cold group has
    salt = F.when(F.col("__hot_total").isNotNull(), 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).otherwise(0).cast("int")
    both = seen.withColumn("__salt", salt).join(cold, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__salt") == F.col("__cold_salt")), "left")
    return both.select(*coded.columns, F.coalesce("__hot_total", "__total").alias("label_error"))
