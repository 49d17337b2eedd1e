import math
import zlib
from collections import Counter

import numpy as np
import pytest

from impactlens.llm import lm_bloom as L
from impactlens.llm import queries
from impactlens.llm.common import read_table


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    """(n_tokens, n_known, train_tokens, base_score) of each row."""
    counts = Counter(w for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10 for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((len(w), sum(counts[x] > 0 for x in w), total,
                    sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)))
    return out


def test_filter_never_misses():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 30_000, dtype=np.uint64) * np.uint64(2)
    q = rng.integers(1, 20, 30_000)
    blocks = -(-int(q.sum()) * L.BITS_PER_ITEM // L.BLOCK)
    built = L.Filter(blocks)
    built.add(h, q)
    built.add(h[:500], q[:500] * 0, L.PAIR)  # level 0 stores nothing
    got = built.seal().levels(h)
    assert (got >= q).all() and (got == q).mean() > 0.95
    other = built.levels(rng.integers(0, 2**63, 30_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (other > 0).mean() < 0.06
    assert (built.levels(h, L.PAIR) > 0).mean() < 0.06
    # A run of blocks answers as the whole filter does.
    first, last = blocks // 3, 2 * blocks // 3
    own = (L.block_of(h, blocks) >= first) & (L.block_of(h, blocks) < last)
    run = L.Filter(blocks, first, last - first)
    run.add(h[own], q[own])
    assert (run.seal().levels(h[own]) == got[own]).all()
    assert L.Filter(1).seal().levels(h[:0]).tolist() == [] and L.level_of(np.array([0, 1, 2, 3, 4])).tolist() == [0, 1, 2, 2, 3]


def test_cases(spark):
    rows = [(i, f"the cat {i % 7} sat on the mat of {i % 3}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "  \n"), (None, "the cat"), (7, "The CAT"), (7, "The CAT"), (103, "word " * 100_000), (104, "neverseen é")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, score int, h string")
    got = L.score(df).collect()
    key = lambda x: (x[0], x[1], round(x[3], 6))
    assert sorted(map(key, ((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got))) == sorted(map(key, brute(rows)))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out and by[100].n_tokens == 1 and by[103].n_tokens == 100_001
    assert L.score(df.limit(0)).collect() == []
    untrained = df.where("crc32(cast(doc_id as string)) % 10 = 0")
    assert untrained.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in L.score(untrained).collect())


def test_pairs_help(spark):
    """A text of familiar pairs scores higher than the same words shuffled."""
    rng = np.random.default_rng(1)
    chain = [f"w{i}" for i in range(200)]
    texts = [" ".join(chain[(s + k) % 200] for k in range(50)) for s in rng.integers(0, 200, 200)]
    mixed = [" ".join(rng.permutation(t.split())) for t in texts[:20]]
    held = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    used = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10]
    rows = list(zip(used, texts)) + [(held[0], texts[0])] + list(zip(held[1:], mixed))
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].score > got[held[0]].base_score + 20
    assert all(got[i].score < got[held[0]].score - 20 for i in held[1:21])


def n_grams(rows):
    """Counts of the hashes of words and of pairs in the training rows."""
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            h, _ = L.stream([t])
            words.update(h[1:].tolist())
            pairs.update(L.pairs_of(h).tolist())
    return words, pairs


def test_no_n_gram_is_lost(spark, monkeypatch):
    """Many blocks, small chunks, one word in a third of all places: every
    count is there, exact for words, at its level or above for all."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 60_000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("hot" if k % 3 == 0 else f"w{k}" for k in rng.zipf(1.2, 300) % 50_000)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, pairs = n_grams(rows)
    for run_blocks in (1, 64):
        answered, model = L.answer_chunks(df, run_blocks)
        assert L.blocks_for(model.tokens) >= 5
        assert (model.tokens, model.vocabulary) == (sum(words.values()), len(words))
        right = total = 0
        found = answered.collect()
        assert len(found) > 10
        for r in found:
            chunk = L.Chunk.load(r.path)
            counts = np.frombuffer(r.word_counts, np.int64)
            assert counts.tolist() == [words[h] for h in chunk.words.tolist()]
            for of, h, levels in ((words, chunk.words, r.word_levels), (pairs, chunk.pairs()[0], r.pair_levels)):
                true = L.level_of(np.array([of[x] for x in h.tolist()]))
                got = np.frombuffer(levels, np.uint8)
                assert (got >= true).all()
                right, total = right + (got == true).sum(), total + len(got)
        assert right > 0.97 * total


def test_work_grows_with_the_text(spark, monkeypatch):
    """Over three sizes and at least 16 runs: every distinct n-gram of a chunk
    is dealt once, whatever the size of the filter, and the number of blocks in
    a run changes no score."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 100_000)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 50_000) for _ in range(1600)]
    dealt_bytes = []
    for n in (400, 800, 1600):
        df = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string").coalesce(2)
        listed = L.write_chunks(df, "doc_id", "text")
        trained = listed.agg({"trained": "sum"}).first()[0]
        rows = L._deal(listed, L.blocks_for(trained), 1).selectExpr("run", "chunk", "octet_length(words) + octet_length(pairs) AS n").collect()
        distinct = 0
        for r in listed.collect():
            chunk = L.Chunk.load(r.path)
            distinct += len(chunk.words) + len(chunk.pairs()[0])
        assert sum(r.n for r in rows) == 8 * distinct and len({(r.run, r.chunk) for r in rows}) == len(rows)
        dealt_bytes.append(8 * distinct / sum(len(t) for t in texts[:n]))
        runs = len({r.run for r in rows})
    assert runs >= 16 and max(dealt_bytes) < 1.1 * min(dealt_bytes)
    one, many = ({r.doc_id: r.score for r in L.score(df, run_blocks).collect()} for run_blocks in (1, 64))
    assert one == many


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_documents(spark, sf):
    rows = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    want = dict(zip(rows, brute(list(rows.items()))))
    got = queries.op5_lm_bloom(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) >= 1.02 * sum(r.base_score for r in held)
