import numpy as np

from impactlens.llm import embed_lsh as E
from impactlens.llm import queries
from impactlens.llm.common import read_table


def brute(rows, threshold=0.93):
    """id -> (links, component) by comparing all pairs of one label."""
    ok = [(i, label, E.vector(v)) for i, v, label in rows]
    links, of = {i: 0 for i, *_ in ok}, {i: i for i, *_ in ok}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, li, x), (j, lj, y) = ok[a], ok[b]
            if x is None or y is None or li is None or li != lj or len(x) != len(y):
                continue
            if np.array_equal(x, y) or x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                of[q] = p
    return {i: (links[i], root(i)) for i in links}


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append(([float(x) for x in (base + 0.25 * rng.normal(size=16)).astype(np.float32)], label))
    rows += [rows[0]] * 7 + [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([], 1),
                             ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([float("inf"), 1.0], 1)]
    order = rng.permutation(len(rows))
    rows = [(int(100 + i), *rows[j]) for i, j in enumerate(order)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                               "vec_id long, embedding array<float>, label int, n_links string, kept int")
    want = brute(rows)
    for block in (1500, 4):
        monkeypatch.setattr(E, "BLOCK", block)
        got = E.near_vectors(df, recall=0.9999999).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    wide = E.near_vectors(df.withColumn("embedding", df.embedding.cast("array<double>")), recall=0.9999999)
    assert {r.vec_id: (r.n_links, r.component_id) for r in wide.collect()} == want
    assert E.near_vectors(df.limit(0)).collect() == []


def test_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (6, [1.0, 0.0], 2)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 3, 0, True), (4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (6, 0, 6, True)]


def test_planted_links(spark):
    """With default parameters but small buckets: pairs whose cosine is just
    above the threshold are found, none just below is linked."""
    rng = np.random.default_rng(9)
    rows, close = [], 0
    for k in range(1500):
        cosine = 0.93 + (1 if k % 3 else -1) * (0.0001 + 0.0099 * rng.random())
        x, y = rng.normal(size=(2, 48))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (cosine * x + np.sqrt(1 - cosine**2) * y).tolist(), 0)]
        close += cosine >= 0.93
    signs, tables = E.plan(len(rows), 0.93, 0.999, 4)
    assert signs >= 9 and tables >= 15
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df, bucket=4).collect()}
    want = {2 * k: (int(k % 3 > 0), 2 * k) for k in range(1500)} | {2 * k + 1: (int(k % 3 > 0), 2 * k + (k % 3 == 0)) for k in range(1500)}
    assert close == 1000 and all(got[i][0] <= want[i][0] for i in want)
    found = sum(got[i] == want[i] for i in want if want[i][0])
    assert found >= 0.99 * 2 * close


def test_recall(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in read_table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op3_embedding_lsh(spark, "/root/testdata/sf0.001").collect()}
    assert sum(x[0] for x in got.values()) >= 0.9 * sum(x[0] for x in want.values()) and len(got) == len(want)
