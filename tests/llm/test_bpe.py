import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = bpe.ByteBPE.from_file(PATH, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fixed_texts(both):
    own, peer = both
    for text in ["", " ", "a", "don't can't we'll I'm", "  two  spaces\n\n tabs\t", "naïve café", "日本語 テキスト", "🙂🙂 ok", "x" * 5000, " " * 3000, "=" * 3000, "a\x1cb\x85c d", "1½²Ⅷ٣", "under_score __init__ _", "<|endoftext|>"]:
        assert own.encode(text) == peer.encode_ordinary(text), text
        assert own.decode_bytes(own.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    own, peer = both
    assert own.encode(text) == peer.encode_ordinary(text)


def test_pieces_and_caches(both):
    own, peer = both
    rng = random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choice(b"aabethinsrou =-\xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert own.encode_piece(piece) == peer._encode_single_piece(piece)


def test_append_and_edit(both):
    own, _ = both
    rng = random.Random(4)
    table = bpe.PrefixTable(own)
    for _ in range(40):
        table.append(bytes(rng.choice(b"thequickbrown fox") for _ in range(rng.randint(0, 30))))
        assert table.ids() == own.encode_piece(table.data)
    for _ in range(60):
        start = rng.randint(0, len(table.data))
        end = min(len(table.data), start + rng.randint(0, 5))
        again = table.replace(start, end, bytes(rng.choice(b"etaoin ") for _ in range(rng.randint(0, 6))))
        assert table.ids() == own.encode_piece(table.data) if table.data else table.ids() == []
        assert again <= len(table.data)


def test_rows(spark, both):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "x"), (4, None), (5, ""), (6, "long " * 20_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_decode(df, PATH, public_tokenizers.PATTERN, with_ids=True).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    want = sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or "")))
    for r, (doc, text) in zip(got, want, strict=True):
        ids = both[1].encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (doc, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
