"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities; the forward algorithm gives that sum, and
expectation-maximisation over the same sums fits the pieces, each round one pass
over all training words. A text's log probability is the sum over its words; the
language with the largest one wins.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import kept
from strandline.workspace import discard, materialize

UNDETERMINED = "und"
WORD = regex.compile(r"\p{L}+")
#: A worker's cache of word scores starts again when it has grown beyond this size.
CACHED_WORDS = 600_000
#: Languages that are fitted and scored together, so what is sent to all executors has at most 8 bytes x pieces x this.
TOGETHER = 32
#: Texts are scored together until they have so many words; distinct words until they have so many bytes.
WORDS_TOGETHER, BYTES_TOGETHER = 200_000, 100_000
#: Bytes of words that no sum can underflow for.
_SHORT = 36
_TINY = 1e-180


def spaced(text: str | None) -> list[str]:
    """What stands between white space in the lower-cased text; each is then cut into words once, however often it stands there."""
    return text.lower().split() if text else []


def _words(run: str) -> list[str]:
    """Runs of letters."""
    return [run] if run.isalpha() else WORD.findall(run)


def _spell(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace")


def read_pieces(path: str) -> list[bytes]:
    """All pieces of the vocabulary and every single byte, in order."""
    with open(path, "rb") as lines:
        return sorted({base64.b64decode(line.split()[0]) for line in lines} | {bytes([b]) for b in range(256)})


@dataclass
class Lattice:
    """All pieces in some words: where they start and end, among the words' boundaries laid end to end.

    ``steps`` cuts them by how far from their word's beginning they start.
    """

    firsts: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    steps: np.ndarray
    longest: int

    def forward(self, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum over all cuts up to each boundary, one column for each of ``probs``, and the logarithm of its scale."""
        size = int(self.sizes.sum()) + len(self.sizes)
        sums, scale = np.zeros((size, probs.shape[1])), np.zeros((size, probs.shape[1]))
        sums[self.firsts] = 1.0
        long = np.flatnonzero(self.sizes > _SHORT)
        for t in range(len(self.steps) - 1):
            if len(long) and t:
                long = long[self.sizes[long] >= t]
                at = self.firsts[long] + t
                scale[at] = scale[at - 1]
                for k in np.flatnonzero(((sums[at] < _TINY) & (sums[at] > 0)).any(axis=1)):
                    low = np.where((sums[at[k]] < _TINY) & (sums[at[k]] > 0), _TINY, 1.0)
                    sums[at[k] : at[k] + min(self.longest, self.sizes[long[k]] - t) + 1] /= low
                    scale[at[k]] += np.log(low)
            part = slice(self.steps[t], self.steps[t + 1])
            sums[self.ends[part]] += sums[self.starts[part]] * probs[part]
        last = self.firsts[long] + self.sizes[long]
        scale[last] = scale[last - 1]
        return sums, scale

    def log_sums(self, probs: np.ndarray) -> np.ndarray:
        """log P of each word in each column."""
        sums, scale = self.forward(probs)
        last = self.firsts + self.sizes
        return np.log(np.maximum(sums[last], 5e-324)) + scale[last]

    def expected(self, probs: np.ndarray) -> np.ndarray:
        """How often each piece is used in a cut of its word, by the posterior of the cuts; ``probs`` has one column."""
        sums, scale = (x[:, 0] for x in self.forward(probs))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = sums[self.starts] * probs[:, 0] / sums[self.ends] * np.exp(scale[self.starts] - scale[self.ends])
        share = np.where(np.isfinite(share), share, 0.0)
        reached, used = np.zeros(len(sums)), np.empty(len(share))
        last = self.firsts + self.sizes
        reached[last] = sums[last] > 0
        for t in range(len(self.steps) - 2, -1, -1):
            part = slice(self.steps[t], self.steps[t + 1])
            used[part] = reached[self.ends[part]] * share[part]
            np.add.at(reached, self.starts[part], used[part])
        return used


class Pieces:
    """A vocabulary as a tree of bytes; a piece's row is its place in ``pieces``."""

    def __init__(self, pieces: Sequence[bytes]):
        nodes = {b"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        edges = sorted((nodes[prefix[:-1]] << 8 | prefix[-1], node) for prefix, node in nodes.items() if prefix)
        self.keys = np.array([k for k, _ in edges], np.int32)
        self.below = np.array([node for _, node in edges], np.int32)
        self.row = np.full(len(nodes), -1, np.int32)
        self.row[[nodes[p] for p in pieces]] = np.arange(len(pieces))
        self.count = len(pieces)
        self.longest = max(map(len, pieces), default=0)

    def lattice(self, words: Sequence[bytes]) -> Lattice:
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        begins = np.cumsum(sizes) - sizes
        stops = (begins + sizes)[word]
        at = np.arange(len(data), dtype=np.int32)
        node, found = np.zeros(len(data), np.int32), []
        for n in range(1, self.longest + 1):
            key = node << 8 | data[at + n - 1]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[edge] == key
            at, node = at[alive], self.below[edge[alive]]
            row = self.row[node]
            some = row >= 0
            found.append((at[some], np.full(int(some.sum()), n, np.int32), row[some]))
            more = at + n < stops[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        start, length, rows = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32),) * 3
        offset = start - begins[word[start]]
        # short numbers are sorted by their digits
        order = np.argsort(offset.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else offset, kind="stable")
        start, length, rows, offset = start[order], length[order], rows[order], offset[order]
        steps = np.searchsorted(offset, np.arange(int(sizes.max(initial=0)) + 1))
        boundary = start + word[start]
        return Lattice(begins + np.arange(len(words)), sizes, boundary, boundary + length, rows, word[start], steps, self.longest)


def _batches(words: Sequence[bytes]) -> Iterator[slice]:
    """Slices of ``words`` with about BYTES_TOGETHER bytes each."""
    first, size = 0, 0
    for i, word in enumerate(words):
        size += len(word)
        if size >= BYTES_TOGETHER:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(words):
        yield slice(first, len(words))


@dataclass
class PieceModel:
    """Piece probabilities: ``probs`` has a row for each piece and a column for each of ``langs``."""

    langs: list[str]
    pieces: Pieces
    probs: np.ndarray
    #: Tells models apart that one worker meets.
    number: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """log P of each word in each language."""
        data = [_spell(w) for w in words]
        out = np.empty((len(words), len(self.langs)))
        for part in _batches(data):
            lattice = self.pieces.lattice(data[part])
            out[part] = lattice.log_sums(self.probs[lattice.rows])
        return out

    def expected(self, langs: np.ndarray, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``words`` (spelled), each of a language by its number and so many times."""
        out = np.zeros_like(self.probs)
        for part in _batches(words):
            lattice = self.pieces.lattice(words[part])
            lang = langs[part][lattice.words]
            used = lattice.expected(self.probs[lattice.rows, lang][:, None]) * counts[part][lattice.words]
            np.add.at(out, (lattice.rows, lang), used)
        return out


def uniform(pieces: Sequence[bytes], langs: Sequence[str]) -> PieceModel:
    return PieceModel(list(langs), Pieces(pieces), np.full((len(pieces), len(langs)), 1.0 / max(len(pieces), 1)))


def improved(model: PieceModel, expected: np.ndarray, added: float) -> PieceModel:
    """The model whose probabilities are the expected counts, each with ``added``."""
    smooth = expected + added
    return PieceModel(model.langs, model.pieces, smooth / smooth.sum(axis=0))


class Scorer:
    """Sums of a model's word scores, with those of words it has met; starts them again when they are many."""

    def __init__(self, model: PieceModel, cached: int = CACHED_WORDS):
        self.model, self.cached = model, cached
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(model.langs)))

    def _learn(self, runs: list[str]) -> None:
        """Words are scored; a run of several, or of none, is the sum over them."""
        apart = {run: WORD.findall(run) for run in runs if not run.isalpha()}
        alone = [run for run in runs if run not in apart]
        words = sorted({*alone, *(w for own in apart.values() for w in own if w not in self.rows)})
        self._add(words, self.model.word_scores(words))
        sums = np.zeros((len(apart), len(self.model.langs)))
        at = [self.rows[w] for own in apart.values() for w in own]
        np.add.at(sums, np.repeat(np.arange(len(apart)), [len(own) for own in apart.values()]), self.scores[at])
        self._add(list(apart), sums)

    def _add(self, runs: list[str], scores: np.ndarray) -> None:
        known = len(self.rows)
        self.rows.update(zip(runs, range(known, known + len(runs)), strict=True))
        self.scores = np.concatenate([self.scores[:known], scores])

    def totals(self, texts: Iterable[str | None]) -> Iterator[np.ndarray | None]:
        """log P of each text in each language, in order, or nothing if it has no letter; a few texts are looked at together."""
        waiting: list[list[str]] = []
        many = 0
        for text in texts:
            waiting.append(spaced(text))
            many += len(waiting[-1])
            if many >= WORDS_TOGETHER:
                yield from self._sum(waiting)
                waiting, many = [], 0
        yield from self._sum(waiting)

    def _sum(self, texts: list[list[str]]) -> Iterator[np.ndarray | None]:
        if len(self.rows) > self.cached:
            self.rows, self.scores = {}, self.scores[:0]
        fresh = set(chain.from_iterable(texts)).difference(self.rows)
        if fresh:
            self._learn(sorted(fresh))
        sizes = [len(runs) for runs in texts]
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        ends = np.cumsum(sizes)
        for runs, size, end in zip(texts, sizes, ends):
            known = any(run.isalpha() or WORD.search(run) for run in runs)
            yield self.scores[at[end - size : end]].sum(axis=0) if known and self.model.langs else None


def _scorer(sent) -> Scorer:
    """The worker's scorer for a broadcast model: the next task of the same query goes on with its words."""
    return kept(sent.value.number, lambda: Scorer(sent.value))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all given rows of lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            size = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(lang, Counter()).update(runs := spaced(text.as_py()))
                size += len(runs)
                if size >= WORDS_TOGETHER * 5:
                    yield put_out(counts)
                    counts, size = {}, 0
            yield put_out(counts)

    def put_out(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, ns = [], [], []
        for lang, own in counts.items():
            cut: Counter = Counter()
            for run, n in own.items():
                for word in _words(run):
                    cut[word] += n
            langs += [lang] * len(cut)
            words += cut.keys()
            ns += cut.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, pieces: Sequence[bytes], langs: Sequence[str], rounds: int = 3, added: float = 0.1) -> PieceModel:
    """Expectation-maximisation of the piece probabilities of ``langs`` over all words of theirs in ``counts`` (lang, word, n).

    Each round sums what the tasks expect; the driver sees one number a piece and language.
    """
    spark = counts.sparkSession
    model = uniform(pieces, langs)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value  # noqa: B023
            number = {lang: i for i, lang in enumerate(now.langs)}
            total = np.zeros_like(now.probs)
            for batch in batches:
                numbers = np.array([number[lang] for lang in batch.column(0).to_pylist()], np.int64)
                total += now.expected(numbers, [_spell(w) for w in batch.column(1).to_pylist()], batch.column(2).to_numpy())
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(total[at, lang])], names=["piece", "lang", "n"])

        found = counts.select("lang", "word", "n").mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros_like(model.probs)
        expected[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        model = improved(model, expected, added)
        sent.destroy()
    return model


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def train(docs: DataFrame, path: str, together: int = TOGETHER) -> list[PieceModel]:
    """Fit on all rows whose ``fold`` is not 0, with a language and a text; languages of one model are at most ``together``."""
    counts = materialize(word_counts(docs.filter(fold() != 0).filter("lang is not null and text is not null")), "langid-vocabulary")
    pieces = read_pieces(path)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    groups = [langs[i : i + together] for i in range(0, len(langs), together)]
    models = [fit(counts if len(groups) == 1 else counts.filter(F.col("lang").isin(group)), pieces, group) for group in groups]
    discard(counts)
    return models


def identify(docs: DataFrame, models: Sequence[PieceModel], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred and score for each row; only ``text`` is looked at.

    A text that is null, empty or has no letter, and any text where nothing could
    be learned, gives ``und`` with score 0. The score is the winner's posterior
    under equal priors; of equal languages the first by name wins. No shuffle; one
    pass over the texts for each model.
    """
    score = F.when(F.col("__lang") == UNDETERMINED, 0.0).otherwise(F.exp(F.col("__best") - F.col("__all")))
    return _judged(docs, models, keep).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__lang").alias("lang_pred"), F.least(score, F.lit(1.0)).alias("score"))


def determined(docs: DataFrame, models: Sequence[PieceModel]) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns, whatever these are called."""
    rows = _judged(docs, models, docs.columns).filter(F.col("__lang") != UNDETERMINED)
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _judged(docs: DataFrame, models: Sequence[PieceModel], keep: Sequence[str]) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    rows = rows.select("*", F.lit(UNDETERMINED).alias("__lang"), F.lit(0.0).alias("__best"), F.lit(0.0).alias("__all"))
    for model in models:
        rows = _better(rows, model)
    return rows


def _better(rows: DataFrame, model: PieceModel) -> DataFrame:
    """``rows`` with the best language so far, its log probability, and that of all languages together."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        langs = scorer.model.langs
        for batch in batches:
            *kept, texts, lang, best, every = batch.columns
            lang, best, every = lang.to_pylist(), best.to_pylist(), every.to_pylist()
            for i, total in enumerate(scorer.totals(value.as_py() for value in texts)):
                if total is None:
                    continue
                top = int(total.argmax())
                now = float(total[top] + np.log(np.exp(total - total[top]).sum()))
                every[i] = now if lang[i] == UNDETERMINED else float(np.logaddexp(every[i], now))
                if lang[i] == UNDETERMINED or total[top] > best[i]:
                    lang[i], best[i] = langs[top], float(total[top])
            yield pa.RecordBatch.from_arrays([*kept, texts, pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(every, pa.float64())], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
