import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from impactlens.llm import chat_format as C
from impactlens.llm import queries
from impactlens.llm.common import read_table

words = st.text(st.one_of(st.sampled_from("<|\\nim_startend>\n "), st.characters(exclude_categories=["Cs"])), max_size=40)


@given(st.lists(st.tuples(words, words), max_size=5))
def test_reversible(turns):
    text, starts, ends = C.render(turns)
    assert C.parse(text) == turns
    assert [C.unescape(text[s:e]) for s, e in zip(starts, ends)] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("record, turns", [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
     [("user", "a"), ("assistant", "b")]),
    ({"data": {"user": "u", "assistant": "a"}}, [("user", "u"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": None}], "id": 7},
     [("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"text": "b"}]},
                   {"role": "assistant", "content": "c"}, {"role": "user", "content": []}]},
     [("user", "ab"), ("assistant", "c"), ("user", "")]),
    ({"prompt": "p", "response": "r", "score": {"by": [1, 2]}}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "q"}]}, None),
    ({"prompt": "a\ud800b\ud83d\ude42", "response": "\udfff"}, [("user", "a\ufffdb🙂"), ("assistant", "\ufffd")]),
    ({"messages": []}, []), ({"messages": ["x", {"role": "user", "content": "q"}]}, None), ({"what": 1}, None), ([1], None)])
def test_layouts(record, turns):
    assert C.canonical(json.dumps(record))[2] == turns


def test_bad_records(spark):
    bad = [None, "no json", '{"odd": 1}', '{"a":' * 3000 + "1" + "}" * 3000, '{"\\ud800": 1}', "[" * 100_000]
    df = spark.createDataFrame(list(enumerate(bad)), "conv_id long, record string")
    got = C.read_back(C.format_records(df)).collect()
    assert [(r.conv_id, r.n_turns, r.formatted_chars) for r in got] == [(i, None, None) for i in range(len(bad))]
    assert C.read_back(C.format_records(df.limit(0))).collect() == []
    strange = spark.createDataFrame([(1, "no template", None, None, "x"), (2, f"{C.START}a", [0], [9], "x")],
                                    "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>, layout string")
    assert [r.n_turns for r in C.read_back(strange).collect()] == [None, None]
    parts = strange.selectExpr("*", "NULL AS lone", "0L AS part")
    assert sorted((r.conv_id, r.n_turns) for r in C.digest_conversations(parts).collect()) == [(1, None), (2, None)]


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_nulls_and_ties(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, None, "x", 9), (1, 1, None, "x", 9), (2, None, "assistant", "<|im_end|>", 9),
            (None, 0, "user", "a", 9), (None, 0, "user", "a", 9), (3, 0, "system", "", 9), (3, 1, "user", "q", 9),
            (3, 2, "assistant", "z" * 200_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout int")
    got = sorted(((r.conv_id or 0, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
                  for r in C.conversations(df).collect()))
    one = digests([("user", "a")])
    assert got == sorted([(0, *one), (0, *one), (1, *digests([("user", ""), ("", "x"), ("", "x")])),
                          (2, *digests([("assistant", "<|im_end|>")])),
                          (3, *digests([("system", ""), ("user", "q"), ("assistant", "z" * 200_000)]))])


def test_conversation_of_many_parts(spark):
    """A conversation that holds a third of all rows, cut into parts of a
    bounded size, reads back as it would from one."""
    rows = [(7, i, "user" if i % 2 else "assistant", f"<|{'x' * (i % 50)} é{i}") for i in range(3000)]
    rows += [(100 + i // 2, i % 2, "user" if i % 2 else "assistant", f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    parts = C.assemble(df, record_bytes=4000)
    sizes = [len(r.record) for r in parts.where("conv_id = 7").collect()]
    assert len(sizes) > 50 and max(sizes) < 8000
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.conversations(df, record_bytes=4000).collect()}
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    assert got == {k: digests(t) for k, t in want.items()}
    whole = {r.conv_id: r.formatted_chars for r in C.conversations(df).collect()}
    assert whole == {r.conv_id: r.formatted_chars for r in C.conversations(df, record_bytes=4000).collect()}


def test_conversations(spark, sf_small):
    rows = read_table(spark, sf_small, "conversations").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", s := "<|im_end|><|im_start|>assistant ok"), ("assistant", s)]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in queries.op9_chat_format(spark, sf_small).collect()}
    assert got == {k: digests(v) for k, v in want.items()}
