import hashlib

from pyspark.sql import functions as F

from impactlens.llm import queries
from impactlens.llm import spotsigs as S
from impactlens.llm.common import read_table


def sets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [set(r.sigs) for r in S.with_signatures(df, F.col("text"), "sigs").orderBy("i").collect()]


def test_signatures(spark):
    a, b, c, d, e = sets(spark, ["The cat of the house is red", "the CAT, of the house is red.", "tiny cat of the house is red", None, "..."])
    assert a == b and len(a) == 3 and a - c and a & c and d == e == set()
    plain, longer = sets(spark, ["zip zap zop", "zip zap zop " * 40 + "the end of it all"])
    assert len(plain) == 3 and longer


def brute(rows):
    known = sorted({i for i, _ in rows if i is not None})
    first = {i: min(t or "" for j, t in rows if j == i) for i in known}
    out = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 4
        nxt = "" if i is None else first[known[(known.index(i) + 1) % len(known)]]
        edited = t[:len(t) - k] + nxt[:k]
        out.append((i, t, nxt, edited))
    return out


def check(spark, rows, got):
    want = brute(rows)
    assert len(got) == len(want)
    texts = sorted({x for w in want for x in w[1:]})
    of = dict(zip(texts, sets(spark, texts)))

    def like(x, y):
        x, y = of[x], of[y]
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    fingerprint = lambda x: ",".join(map(str, sorted(of[x])))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(
        ((i, len(t), sha(e), fingerprint(t), fingerprint(e), like(t, e), 0.0 if i is None else like(t, n))
         for i, t, n, e in want), key=key)


def test_neighbours(spark):
    rows = [(5, "the cat sat on the mat é漢🙂"), (9, None), (2, "of all the things " * 30), (2, "of all the things " * 30), (7, ""),
            (None, "the lone one is here"), (11, "x"), (40, "the big " * 100_000), (-3, "a b c d e f g h")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")
    check(spark, rows, S.compare_neighbours(df).collect())
    assert S.compare_neighbours(df.limit(0)).collect() == []
    one = S.compare_neighbours(df.where("doc_id = 5")).collect()[0]
    assert one.near_next == 1.0


def test_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    df = queries.op10_spotsigs(spark, sf_small)
    got = df.collect()
    check(spark, rows, got)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_pairs(spark, sf_small):
    docs = read_table(spark, sf_small, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sets(spark, [t for _, t in rows])
    same = {}
    for (i, _), s in zip(rows, found):
        if s:
            same.setdefault(frozenset(s), []).append(i)
    reps = [(min(v), k) for k, v in same.items()]
    want = {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if len(x & y) >= 0.8 * len(x | y)}
    assert {(r.a, r.b) for r in S.near_pairs(docs).collect()} == want
    members = {r.doc_id: r.representative for r in S.classes(docs).collect()}
    assert all(members[i] == min(v) for v in same.values() for i in v)
