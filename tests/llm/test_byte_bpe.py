import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from impactlens.llm import byte_bpe as B
from impactlens.llm.common import read_table


@pytest.fixture(scope="module")
def coder():
    return B.codec(B.model_json(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                             mergeable_ranks=B.read_ranks(P.path("byte_bpe_50k.tiktoken")))


def ids_of(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_as_tiktoken(coder, truth, text):
    raw = coder.encode([text])[0]
    assert ids_of(raw) == truth.encode_ordinary(text)
    assert coder.decode(raw) == text.encode()
    ids, starts, ends = coder.offsets(text)
    assert ids == ids_of(raw)
    for i, s, e in zip(ids, starts, ends):
        assert coder.bytes_of[i] in text[s:e].encode()


def test_split_characters(coder, truth):
    text = "a🙂é漢字 naïve 👩‍👩‍👧"
    ids = truth.encode_ordinary(text)
    assert "".join(B.decode_chunks([[i] for i in ids], coder)) == text
    assert "".join(B.decode_chunks([ids[:-1]], coder)).endswith("�")


def test_table(spark, coder, truth):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 6), (None, "", 7), (3, "x" * 300_000 + " é\n\n  z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.round_trip(df).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted(
        (r[0] or -1, len(truth.encode_ordinary(r[1] or ""))) for r in rows)
    assert {r.decoded_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(rows[4][1].encode()).hexdigest()}
    back = B.decode(B.encode(df)).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in rows)
    assert B.round_trip(df.limit(0)).collect() == []


def test_documents(spark, sf_small, truth):
    docs = read_table(spark, sf_small, "documents")
    got = {r.doc_id: r for r in B.round_trip(docs).collect()}
    for r in docs.collect():
        ids = truth.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_ids_outside_the_table(spark, coder):
    """They decode to U+FFFD; none stops a task."""
    n = len(coder.bytes_of)
    assert coder.decode_ids([n, -1, None, 2**40]) == "\ufffd".encode() * 4
    assert coder.decode(struct.pack("<2I", 2**32 - 1, n)) == "\ufffd".encode() * 2
    assert list(B.decode_chunks([[n], iter([-5])], coder)) == ["\ufffd", "\ufffd"]
    hello = ids_of(coder.encode(["hello"])[0])
    df = spark.createDataFrame([(1, [*hello, 99_999_999]), (2, [-3, None]), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in B.decode(df).collect()} == {1: "hello\ufffd", 2: "\ufffd\ufffd", 3: ""}
