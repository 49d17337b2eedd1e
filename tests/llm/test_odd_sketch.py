import math
import random

import numpy as np

from impactlens.llm import odd_sketch as O
from impactlens.llm import queries
from impactlens.llm.common import read_table


def plain_set(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=4):
    """id -> (size, component) by comparing all pairs that share a run."""
    sets = [(i, plain_set(t, width)) for i, t in rows]
    at, of = {}, {i: i for i, _ in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, (a, s) in enumerate(sets):
        shared = {}
        for g in s:
            for j in at.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            at[g].append(i)
        for j, n in shared.items():
            b, u = sets[j]
            if 100 * n >= 80 * (len(s) + len(u) - n):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = 400
            both = int(2 * n * share / (1 + share))
            items = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = O.minhash(items[:n]), O.minhash(items[n - both:])
            x, y = (np.frombuffer(O.odd_sketch(s), np.uint64)[None] for s in (a, b))
            errors.append(float(O.estimate(O._bits(x, y))[0]) - share)
        if share >= 0.8:
            assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2
        elif share == 0:
            assert np.mean(errors) < 0.35


def test_filter_loses_less_than_bands():
    """The chance that a pair at the threshold has more than MOST_BITS differing
    bits: each unlike sample flips two random bits."""
    n, k = O.SKETCH_BITS, np.arange(O.SKETCH_BITS + 1)
    odd, lost = np.eye(1, n + 1)[0], 0.0
    for unlike in range(O.SAMPLES + 1):
        chance = math.comb(O.SAMPLES, unlike) * 0.2**unlike * 0.8 ** (O.SAMPLES - unlike)
        lost += chance * odd[O.MOST_BITS + 1:].sum()
        for _ in range(2):
            odd = np.append(0, (odd * (1 - k / n))[:-1]) + np.append((odd * k / n)[1:], 0)
    assert lost < (1 - 0.8**O.ROWS) ** O.BANDS


def mixed(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(30):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > 0.03 else word() for w in base]
            rows.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(25):  # neighbours alike, ends not
        k = rng.randrange(95)
        chain = chain[:k] + [word(), word(), word()] + chain[k + 3:]
        rows.append(" ".join(chain))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(10, 60))]) for _ in range(40)]
    rng.shuffle(rows)
    return rows


def test_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = mixed(rng) + ["A b C", "a B\tc\n", "a b c d", "", None, "  \n", "x", "X", "y"] + ["same " * 30] * 9
    rows = list(enumerate(texts, start=10))
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, component_id int, kept string")
    for block in (1500, 3):  # the second splits almost every bucket
        monkeypatch.setattr(O, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in O.near_duplicates(df).collect()}
        assert got == brute(rows)
    kept = {r.doc_id for r in O.drop_copies(df, width=4).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (9, "w " * 200_000 + "end here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in O.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, None, True), (-1, None, True), (3, 2, False), (3, 2, False), (2, 2, True), (9, 9, True)], key=str)
    assert O.near_duplicates(df.limit(0)).collect() == []


def test_repeated_ids(spark):
    """No unlike text goes because of its id; what stays does not depend on
    the order or the partitions of the rows."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "plain words of another kind here")
    near = " ".join(f"w{i}" for i in range(60))
    cases = [
        ([(1, a), (5, a), (5, b)], [(1, a), (5, b)]),
        ([(1, None), (1, ""), (1, a), (2, None), (4, b), (4, b), (4, b.upper())], [(1, None), (1, a), (2, None), (4, b.upper())]),
        ([(None, a), (None, a), (7, a), (7, c), (8, c)], [(None, a), (None, a), (7, a), (8, c)]),
        ([(3, near + " x"), (3, a), (4, near + " y"), (4, b), (9, near + " z")], None),
    ]
    for rows, want in cases:
        kept = set()
        for k in range(2):
            df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, _node string").drop("_node")
            out = O.drop_copies(df.repartition(k + 1, "text"))
            assert out.columns == ["doc_id", "text"]
            kept.add(tuple(sorted(((r.doc_id, r.text) for r in out.collect()), key=str)))
        assert len(kept) == 1
        if want is None:  # one of the near copies, and all unlike texts
            texts = [t for _, t in kept.pop()]
            assert sorted(t[:3] for t in texts) == sorted(["w0 ", a[:3], b[:3]])
        elif (7, c) in rows:
            got = kept.pop()
            assert set(got) <= set(rows) and len(got) == 4 and {t for _, t in got} == {a, c}
        else:
            assert kept.pop() == tuple(sorted(want, key=str))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_odd_sketch(spark, sf).collect()}
    assert got == brute(rows)
