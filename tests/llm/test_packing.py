import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from impactlens.llm import packing as K
from impactlens.llm import queries
from impactlens.llm.common import read_table

PATH = P.path("word_bpe_49k.json")
TRUTH = Tokenizer.from_file(PATH)


def ids(text):
    return [*TRUTH.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(list(" \n\t'sＡé́ ßΣİABc.,&1") + ["<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "it's", "e\u0301.", "a,\u0301"]), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join), max_size=4))
def test_word_by_word(texts):
    got = [list(struct.unpack(f"<{len(r) // 4}I", r)) + [1] for r in K.coder(PATH).encode(texts)]
    assert got == [ids(t) for t in texts]


def test_repeated_words_are_looked_up_once():
    """The work for a word in Python grows with the distinct words of a chunk."""
    looked = []

    class Known(dict):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    own = K.WordCoder(PATH)
    own.known = Known()
    texts = ["of the end, " * 500, "", " \t\n", "the\u00a0end of<|x|>" * 3]
    assert [[*np.frombuffer(r, "<u4").tolist(), 1] for r in own.encode(texts)] == [ids(t) for t in texts]
    assert own.encode([""]) == [b""] and len(looked) < 20


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=12))
def test_plan(histogram):
    plan = K.shortest_pack_first(histogram, 50)
    placed = {}
    for lengths, packs in plan:
        assert sum(lengths) <= 50
        for n in lengths:
            placed[n] = placed.get(n, 0) + packs
    assert placed == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(packs for _, packs in plan) <= 2 * total / 50 + 1


def check(rows, got, size=2048):
    """Every id in one piece, sequences gapless."""
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append(ids(text))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for doc, found in by_doc.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
        expected = sorted((s, len(x[s:s + size]), zlib.crc32(struct.pack(f"<{len(x[s:s + size])}I", *x[s:s + size])), len(x))
                          for x in want[doc] for s in range(0, len(x), size))
        assert pieces == expected
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert set(by_seq) == set(range(len(by_seq)))
    return len(by_seq)


def test_cases(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "the", "x9"]) for _ in range(rng.randrange(90)))) for i in range(300)]
    rows += [(7, "same copy"), (7, "same copy"), (None, "a b"), (None, None), (500, ""), (501, None), (502, "word " * 9000)]
    rows += [(1000 + i, "copy of one text here") for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, length int, offset string")
    n = check(rows, K.pack_documents(df, size=64).collect(), 64)
    total = sum(len(ids(t)) for _, t in rows)
    assert n <= 1.03 * total / 64 + 2
    made = K.sequences(K.pack(K.pieces(df, cut=64, with_ids=True), 64), 64).collect()
    assert sum(r.used for r in made) == total and all(len(r.ids) == 64 for r in made)
    assert sorted(i for r in made for i in r.ids[:r.used]) == sorted(i for _, t in rows for i in ids(t))
    assert K.pack_documents(df.limit(0)).collect() == []


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = queries.op4_packing(spark, "/root/testdata/sf0.01").collect()
    n = check(rows, got)
    assert n * 2048 <= 1.02 * np.sum([r.length for r in got])
