import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from impactlens.llm import pii_weak as W
from impactlens.llm import queries
from impactlens.llm.common import read_table


def plain(text):
    """The base spans as their patterns are written, without any shortcut."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("0123456789.@+- ()ab\né"), max_size=60))
def test_base_as_written(text):
    assert W.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("0123456789.@+- ()ab\n"), max_size=80))
def test_nothing_left(text):
    assert plain(W.redacted(text, W.train({}))) == []


def test_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "+1" + "(" * 300_000,
                 "1 " * 150_000, "A b" * 100_000):
        W.candidates(text)


def test_em_learns_reliability():
    counts = {("card", 1, 1, 1, 0, 0, 2): 200, ("card", -1, -1, -1, 0, 0, 0): 900, ("card", -1, 1, 0, 0, 0, 0): 200,
              ("card", 1, -1, 1, 0, 0, 2): 40, ("local_phone", 0, 0, 1, 0, 0, 2): 50, ("local_phone", 0, -1, -1, 0, 0, 2): 50}
    reliability, prior, post = W.em(counts)
    assert post[("card", 1, 1, 1, 0, 0, 2)] > 0.95 > 0.05 > post[("card", -1, -1, -1, 0, 0, 0)]
    assert reliability["card"][0][1][1] > reliability["card"][0][1][0]
    model = W.train(counts)
    assert model.probability(("local_phone", 0, 0, 1, 0, 0, 2)) > 0.5 > model.probability(("local_phone", 0, -1, -1, 0, 0, 2))


def test_cases(spark):
    text = "Dear John Smith, call 555-867-5309 or mail joe [at] site [dot] com; x@y.co, +1 (803) 555-5351, 10.1.2.3"
    rows = [(1, text, 3, "q"), (1, text, 3, "q"), (2, None, 0, "q"), (3, "", 0, "q"), (None, "é a@b.cd", 8, "q"),
            (4, "x" * 500_000 + " 4111111111111111", 1, "q"), (5, "Version 12 of The Thing, 1234 5678", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    model = W.fit(docs)
    got = {r.doc_id: r for r in W.find(docs, model).collect()}
    assert W.find(docs, model).count() == 7
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone, got[1].n_card) == (1, 1, 1, 0)
    kinds = {s.split(":")[0] for s in got[1].spans.split(",")}
    assert kinds >= {"email", "ip", "phone", "local_phone", "spoken_email", "name"}
    assert got[2].spans == got[3].spans == got[5].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].spans == "email:2:8" and got[4].spans == "card:500001:500017"
    clean = {r.doc_id: r for r in W.redact(docs, model).collect()}
    assert "5309" not in clean[1].text and clean[2].text is None and clean[2].n_chars == 0
    assert clean[None].text == "é [EMAIL]" and clean[None].n_chars == 9 and clean[5].text == rows[6][1]
    none = W.fit(docs.limit(0))
    assert W.find(docs.limit(0), none).collect() == [] and W.redact(docs.limit(0), none).collect() == []


def test_documents(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, sf_small, "documents").collect()}
    got = queries.op2_pii_weak(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(W.joined(want).encode()).hexdigest()
        assert set(W.joined(want).split(",")) - {""} <= set(r.spans.split(","))
