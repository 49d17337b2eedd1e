import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from impactlens.llm import alignment as A
from impactlens.llm.common import read_table
from impactlens.llm.queries import op12_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [None, "", " ", "  ", "a", "x  y\n z\t \tw ", "a\n\nb", "end.\nNext, (one) two)\nthree|", "l'été coûte 12²; ²x ².",
        "naïve 漢字 🙂👩‍👩‍👧 \u0000 x  y\x1cz \x85 q", "▁a b", "a ▁ b", "<s> <|endoftext|> </s> <0x41>", "don't we'll I'M",
        "\n\nA\r\nB.\r\nC", "aaaa" * 300, "Wort." * 200, " lead", "trail ", "A" * 3 + "\n" * 5 + "b %%%\n%x&y#z*\n\n*q"]


@pytest.fixture(scope="module")
def v():
    return A.Vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def whole(v, text):
    """(groups, links) of one text, encoded whole; overlaps by bytes."""
    text = text or ""
    raw = (" " + text).encode()
    a = v.a.encode(" " + text, add_special_tokens=False).ids
    b = v.b.encode(text)
    if not text or b"".join(v.bytes_a[i] for i in a) != raw or b"".join(v.bytes_b[i] for i in b) != raw:
        return [], Counter()
    spans = []
    for ids, of in ((a, v.bytes_a), (b, v.bytes_b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(of[i]), i))
            at += len(of[i])
        spans.append(own)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, links, i, j = [], Counter(), 0, 0
    for cut in cuts:
        sides = []
        for k, own in enumerate(spans):
            at = (i, j)[k]
            end = at
            while end < len(own) and own[end][1] <= cut:
                end += 1
            sides.append(own[at:end])
            i, j = (end, j) if k == 0 else (i, end)
        groups.append("|".join(",".join(str(t[2]) for t in side) for side in sides))
        links.update((x[2], y[2]) for x in sides[0] for y in sides[1] if x[0] < y[1] and y[0] < x[1])
    return groups, links


def brute(v, rows):
    found = [(key, *whole(v, text)) for key, text in rows]
    count, best = Counter(), defaultdict(int)
    for _, _, links in found:
        count.update(links.keys())
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for key, groups, links in found:
        n_a, n_b = (sum(len(g.split("|")[k].split(",")) for g in groups) for k in (0, 1))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), links.total(), sum(n for p, n in links.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in links.items()), sha))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_identity_map(v):
    there = [(a, b) for a, b in enumerate(v.same.tolist()) if b >= 0]
    assert len(there) > 20_000 and all(v.bytes_a[a] == v.bytes_b[b] for a, b in there) and v.cut


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab.,'|éñ1²▁"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_parts_as_whole_texts(v, texts):
    found = A.align(v, texts)
    assert [g.decode() for g in found["groups"]] == [";".join(whole(v, t)[0]) for t in texts]
    assert found["n_links"].tolist() == [whole(v, t)[1].total() for t in texts]


def test_hard_texts(spark, v):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "again a"), (3, "again a")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pairs int")
    want = brute(v, rows)
    assert rows_of(A.link_statistics(df)) == want
    assert rows_of(A.link_statistics(df, frequent=3)) == want
    assert A.link_statistics(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_small, v):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").select("doc_id", "text").collect()]
    want = brute(v, docs)
    assert rows_of(op12_alignment(spark, sf_small)) == want
    few = A.link_statistics(read_table(spark, sf_small, "documents"), frequent=40)
    assert rows_of(few) == want


def test_forgetting_changes_nothing(v, monkeypatch):
    texts = [t or "" for t in HARD]
    want = A.align(v, texts)["groups"]
    monkeypatch.setattr(A, "MEMORY", 20)
    assert [A.align(v, [t])["groups"][0] for t in texts] == want


def test_groups_as_text(spark, v):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = A.token_groups(df).where("not totals").first()
    assert row.groups == ";".join(whole(v, "one two three")[0])
