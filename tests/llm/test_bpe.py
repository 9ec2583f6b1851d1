import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lexiloom.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
OURS = bpe.Codec(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_encodes_as_the_library_does(text):
    ids = OURS.encode(text).tolist()
    assert ids == THEIRS.encode_ordinary(text) and OURS.decode(ids) == text.encode()


def test_spaces_letters_and_long_runs():
    r = random.Random(1)
    alphabet = "ab cdÉé \x1c\x1d\x85　\n\t\r'sll've 12٣!?#漢字\U0001f600\x00"
    for text in ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(500)] + ["a" * 20_000, " *" * 3000, "é" * 999, "<|endoftext|>"]:
        assert OURS.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_hash_is_perfect_and_minimal():
    h = OURS.hash
    assert len(h.keys) == len(RANKS) == len(set(h.keys)) and all(h.get(k) == v for k, v in RANKS.items())
    assert h.get(b"no such token at all") == -1 and bpe.PerfectHash([], []).get(b"x") == -1


def test_query_and_round_trip(spark, documents):
    texts = ["", None, "Hello world", "ünï " * 50, "x" * 200_000]
    docs = documents(texts)
    for r in bpe.round_trip(docs).collect():
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            ids = THEIRS.encode_ordinary(t)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1])
def test_memo_is_bounded(monkeypatch, size):
    monkeypatch.setattr(bpe, "MEMO", size)
    c = bpe.Codec(RANKS, P.PATTERN)
    assert c.encode("some words and some words again").tolist() == THEIRS.encode_ordinary("some words and some words again") and len(c.memo) <= size
