import itertools
import zlib

import numpy as np

from impactlens.llm import quality_crf as Q
from impactlens.llm import queries
from impactlens.llm.common import read_table


def test_forward_backward_brute_force():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 3])
    s, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pair = Q.forward_backward(s, trans, counts)
    want, wanted, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in counts:
        total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        want[at:at + n] = good / total
        wanted += pairs / total
        at += n
    assert np.allclose(got, want) and np.allclose(pair, wanted)


def test_neighbours_matter():
    bins, _, counts = Q.line_features(["a b c.\n### $$$ &&&", "a b c."])
    at = Q.slots(bins, counts)
    assert (at[0, :Q.WIDTH] == at[2, :Q.WIDTH]).all() and (at[0] != at[2]).any()


def test_cases(spark):
    good, bad = "This is a plain line of text, with words.\nAnd here comes one more.", "!!! ### &&& $$$ *** ### !!!\n### ### &&&"
    rows = [(i, good if i % 2 else bad, i % 2, "x", "y") for i in range(60)]
    docs = spark.createDataFrame(rows + [(None, good, 1, "x", "y"), (61, None, 1, "x", "y"), (62, "", 1, "x", "y"),
                                         (63, bad, 0, "x", "y"), (63, bad, 0, "x", "y"), (64, " \n" * 9, 0, "x", "y"),
                                         (65, "word " * 400_000, 0, "x", "y")],
                                 "doc_id long, text string, score int, predicted string, held_out string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == i % 2 for i in range(60))
    assert by[61].score == by[62].score == by[64].score == 0 and by[None].predicted == 1
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and 63 not in {r.doc_id for r in kept.collect()}
    empty = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, empty).collect()} == {0.0, 0.5}
    assert Q.score(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_crf(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    assert len(got) == read_table(spark, sf, "documents").count()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
