"""Ids against the reference library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyward.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
DATA = bpe.load_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(DATA), special_tokens={})
OURS, BACK = bpe.Encoder(DATA, public_tokenizers.PATTERN), bpe.Decoder(DATA)
BYTE_IDS = {token[0]: rank for token, rank in bpe.parse_ranks(DATA).items() if len(token) == 1}

TEXTS = [
    "", " ", "a", "Hello world, it's 2024!", "  two  spaces\n\n\ttabs ", "naïve café Straße 日本語 🙂🙂 ‍", "x" * 5000, "ab" * 3000,
    "aaaaabaaaab" * 50, "<|endoftext|>", "\x00\x01\x02", "http://a.b/c?d=e&f=g#h", "1234567890" * 200, "=" * 999 + "-" * 333,
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabbcethn 's\n.0 é日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert "".join(BACK.pieces(ids)) == text


def test_few_states_give_the_same():
    random.seed(1)
    small = bpe.Encoder(DATA, public_tokenizers.PATTERN, max_pieces=3)
    small.transducer.max_states = 5
    for _ in range(100):
        text = "".join(random.choices("abcdefgh rstin", k=80))
        assert small.encode(text) == THEIRS.encode_ordinary(text)


def test_broken_characters_become_replacements():
    for _ in range(300):
        data = bytes(random.choices([0x41, 0xC3, 0xA9, 0xE6, 0x97, 0xA5, 0xF0, 0x9F, 0x98, 0x82, 0xFF], k=8))
        ids = [BYTE_IDS[b] for b in data]
        assert "".join(BACK.pieces(ids)) == data.decode(errors="replace")


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "same text", 5), (2, "same text", 5), (None, TEXTS[5] * 400, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(frame).collect())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = [
        (i or 0, len(ids := THEIRS.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for i, t, _ in rows
    ]
    assert got == sorted(expected)
    assert bpe.round_trip(frame.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(frame)).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"]), r["text"]) for r in back) == sorted(
        (i or 0, tuple(THEIRS.encode_ordinary(t or "")), t or "") for i, t, _ in rows)
    assert [r["text"] for r in bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
