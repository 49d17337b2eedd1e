from hypothesis import given, settings
from hypothesis import strategies as st

from impactlens.llm import words as W


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbB \n\t\x0b\x0c\r\x1c\x85\xa0é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6), st.integers(1, 40))
def test_equal_words_have_equal_hashes(texts, window):
    old, W.WINDOW = W.WINDOW, window
    try:
        hashes, sizes = W.word_hashes(texts)
    finally:
        W.WINDOW = old
    words = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))


def test_many_words_do_not_collide():
    words = {f"{a}{b}{c}" for a in "abcdefghij" for b in range(200) for c in "klmnopqrst"} | {"ab" * i for i in range(300)} | {"ba" * i for i in range(1, 300)}
    hashes, _ = W.word_hashes([" ".join(words)])
    assert len(set(hashes.tolist())) == len(words - {""})
