import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from impactlens.llm import periodic_runs as P
from impactlens.llm.common import read_table
from impactlens.llm.queries import op13_periodic_runs


def brute_runs(x, shortest=24, repeats=3):
    """Every stretch of equal words q apart, for every q."""
    found = {}
    for q in range(1, len(x) // repeats + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def mixed_text(r, letters, size):
    x = []
    while len(x) < size:
        unit = [r.randrange(letters) for _ in range(r.randint(1, 90))]
        times = r.choice([1, 2, 3, 6, 40 if len(unit) < 8 else 4])
        x += (unit * times)[:r.randint(1, len(unit) * times)]
    return x


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_against_brute_force(letters):
    r = random.Random(letters)
    for _ in range(40):
        texts = [mixed_text(r, letters, r.randint(0, 600)) for _ in range(r.randint(1, 5))]
        assert P.find_runs([np.array(t, np.int64) for t in texts]) == [brute_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=40))
def test_short_periods(before, times, after):
    x = before + (before[-7:] or [1]) * times + after
    assert P.find_runs([np.array(x, np.int64)]) == [brute_runs(x)]


@pytest.mark.parametrize("widest", [8, 32])
def test_periods_beyond_the_widest_block(monkeypatch, widest):
    monkeypatch.setattr(P, "WIDEST", widest)
    r = random.Random(widest)
    for _ in range(30):
        unit = [r.randrange(30) for _ in range(r.randint(1, 300))]
        x = mixed_text(r, 30, 20) + unit * r.randint(3, 5) + mixed_text(r, 30, 20)
        assert P.find_runs([np.array(x, np.int64)]) == [brute_runs(x)]


@pytest.mark.parametrize("m", [16, 32, 128, 4096])
def test_transform_is_exact(m):
    """Cyclic correlation of random values by the transform and by sums."""
    rng = np.random.default_rng(m)
    a, b = rng.integers(0, 200, m), rng.integers(0, 200, m)
    t = P._transform(m)
    fa, fb = (t.forward(v[None, :].astype(float)) for v in (a, b))
    product = fa * fb.reshape(1, -1)[:, t.mirror].reshape(fb.shape)
    got = np.rint(t.inverse(P._reduced(product))[0]).astype(np.int64) % P.PRIME
    want = [int(np.dot(np.roll(a, -d), b)) % P.PRIME for d in range(0, m, max(1, m // 64))]
    assert got[::max(1, m // 64)].tolist() == want


def test_long_text_of_one_word():
    assert P.find_runs([np.zeros(50_000, np.int64)]) == [[(0, 50_000, 1)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf_small):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op13_periodic_runs(spark, sf_small).collect())
    docs = [r for r in read_table(spark, sf_small, "documents").select("doc_id", "text").collect()
            if len((r.text or "").split()) <= 1500]
    wanted = {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert len(wanted) >= 150 and sum(w[1] > 0 for w in wanted.values()) >= 5
    assert [g for g in got if g[0] in wanted] == sorted(wanted.values())
    assert len(got) == read_table(spark, sf_small, "documents").count()


def test_nulls_spaces_and_clashing_columns(spark):
    """Only ASCII white space ends words; null and empty texts have no run."""
    line = "le\u00a0mot x y\t" * 30
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "a " * 30, "d"), (5, line, "e"), (5, line, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.n_words): r for r in P.periodic_runs(df).collect()}
    assert got[(1, 0)].runs == got[(2, 0)].runs == got[(3, 0)].runs == [] and got[(3, 0)].collapsed == ""
    assert [tuple(r) for r in got[(None, 30)].runs] == [(0, 30, 1)] and got[(None, 30)].collapsed == "a"
    assert got[(5, 60)].collapsed == "le\u00a0mot x y" and P.periodic_runs(df).count() == 6
    assert P.digests(P.periodic_runs(df.limit(0))).count() == 0
