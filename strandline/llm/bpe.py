"""Byte-level BPE over a fixed rank file, by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one last token that its encoding can end
in. The table of these tokens is filled from left to right: a candidate token
that ends at byte i is the right one if it may follow the last token of what
stands before it. Two tokens may stand side by side if no merge across their
border would have been made while they were built. Reading the table backwards
gives the encoding; appending bytes only adds entries, and an edit only redoes
entries until the table agrees with the old one over the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a generation of a worker's piece cache, and of its pair cache, which starts again when full.
CACHED_PIECES = 250_000
CACHED_PAIRS = 600_000
_NONE = -1


#: The same splits as the usual pattern in the classes of the standard library's matcher, which is faster.
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FASTER = r""" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What cuts a text into its pieces."""
    exact = regex.compile(pattern).findall
    if pattern != _USUAL:
        return exact
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    classes = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    differ = set().union(*(set(regex.findall(a, every)) ^ set(re.findall(b, every)) for a, b in classes))
    differ.update(map(chr, range(0xD800, 0xE000)))
    ascii_odd = [c for c in differ if c < "\x80"]
    faster = re.compile(_FASTER).findall

    def split(text: str) -> list[str]:
        odd = any(c in text for c in ascii_odd) or not text.isascii() and not differ.isdisjoint(text)
        return exact(text) if odd else faster(text)

    return split


class ByteBPE:
    """Encoder and decoder for the ranks of a vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = splitter(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._earlier: dict[str, bytes] = {}
        self._begins = {token[:n]: _NONE for token in ranks for n in range(1, len(token))} | ranks

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; (token, -1) for a byte; None if merges never give it."""
        if token not in self._halves:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                rank, at = min(
                    ((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)),
                    default=(token, 0),
                )
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                found = (token, _NONE)
            elif len(parts) == 2 and all(p in self.ranks for p in parts):
                found = (self.ranks[parts[0]], self.ranks[parts[1]])
            else:
                found = None
            self._halves[token] = found
        return self._halves[token]

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the border, latest first, and look for a cross merge that would have come sooner."""
        ranks, text = self.ranks, self.bytes_of
        if self.halves(left) is None or self.halves(right) is None:
            return False
        before = len(text) + 1  # a cross merge of a rank below this would have been made
        while True:
            if ranks.get(text[left] + text[right], before) < before:
                return False
            a, b = self.halves(left), self.halves(right)
            left_open, right_open = a[1] != _NONE, b[1] != _NONE
            if left_open and (left > right or not right_open):
                before, left = min(before, left), a[1]
            elif right_open:
                # of equal ranks the leftmost merge comes first, so the cross merge wins a tie here
                before, right = min(before, right + 1), b[0]
            else:
                return True

    def extend_prefixes(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Append to ``last`` the last token of each prefix of ``data`` up to ``stop`` bytes; last[i] is for i + 1 bytes.

        From each start the walk goes on while some token begins like that.
        """
        known, stop = len(last), len(data) if stop is None else stop
        last.extend([_NONE] * (stop - known))
        begins, pairs = self._begins.get, self._pairs
        for start in range(max(0, known + 1 - self.longest), stop):
            left = last[start - 1] if start else _NONE
            for end in range(start + 1, stop + 1):
                token = begins(data[start:end])
                if token is None:
                    break
                if token == _NONE or last[end - 1] != _NONE:
                    continue
                if not start:
                    holds = self.halves(token) is not None
                elif (holds := pairs.get(key := left << 32 | token)) is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    holds = pairs[key] = self._border_holds(left, token)
                if holds:
                    last[end - 1] = token
        if _NONE in last[known:]:
            raise ValueError("the vocabulary lacks a single byte")

    def read_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(self.bytes_of[token])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.halves(whole) is not None:
            return [whole]
        last: list[int] = []
        self.extend_prefixes(data, last)
        return self.read_back(last)

    def pack(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        out = list(map(self._pieces.get, pieces))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self._pack_piece(pieces[at])
        return b"".join(out)

    def _pack_piece(self, piece: str) -> bytes:
        """Two generations of pieces are kept; one that is met again moves to the younger."""
        packed = self._pieces.get(piece) or self._earlier.get(piece)
        if packed is None:
            ids = self.encode_piece(piece.encode("utf-8", "replace"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self._pieces) >= CACHED_PIECES:
                self._earlier, self._pieces = self._pieces, {}
            self._pieces[piece] = packed
        return packed

    def encode(self, text: str) -> list[int]:
        packed = self.pack(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The encoding of one growing or edited piece of bytes, kept as its prefix table."""

    def __init__(self, codec: ByteBPE, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries for what stands already never change."""
        self.data += more
        self.codec.extend_prefixes(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for bytes start to end; returns how many entries were worked out anew.

        Entries before ``start`` stay. Behind the edit, once as many entries in a row
        as the longest token has bytes equal the old ones, all later ones do too.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, agreed, at = old[:start], 0, start
        while at < len(self.data):
            self.codec.extend_prefixes(self.data, last, at + 1)
            was = at - shift
            agreed = agreed + 1 if was >= end and old[was] == last[at] else 0
            at += 1
            if agreed >= self.codec.longest:
                last += old[at - shift :]
                break
        self.last = last
        return at - start

    def ids(self) -> list[int]:
        return self.codec.read_back(self.last)


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each vocabulary and Python process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteBPE.from_file(path, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns id_col, n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids``
    also the ids (array<long>). ``path`` is a rank file that every machine has.
    Each row stands for itself: no shuffle. A null text counts as empty (no
    tokens); repeated rows and null ids pass through; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, id_sums, text_sums, lists = [], [], [], []
            for value in batch.column(1):
                packed = bpe.pack(value.as_py() or "")
                n = len(packed) // 4
                ids = struct.unpack(f"<{n}I", packed)
                counts.append(n)
                id_sums.append(hashlib.sha256(packed).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                if with_ids:
                    lists.append(list(ids))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
