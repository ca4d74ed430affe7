import numpy as np
from tests_llm_help import words_of
from hypothesis import given
from hypothesis import strategies as st

from barloom.llm import words as W

TEXT = st.text(alphabet="aAbBzZ \t\n\r\x0b\x0cé\x85\xa0.!", max_size=40)


@given(st.lists(TEXT, max_size=6))
def test_batches_agree_with_single_texts_and_with_equality_of_words(texts):
    batch = W.batch_word_hashes(texts)
    names = {}
    for text, hashes in zip(texts, batch):
        assert (W.word_hashes(text) == hashes).all()
        expected = words_of(text)
        assert len(expected) == len(hashes)
        for word, value in zip(expected, hashes.tolist()):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_null_empty_and_long_texts(monkeypatch):
    assert len(W.word_hashes(None)) == len(W.word_hashes("")) == 0
    text = "some words of a text " * 30
    whole = W.word_hashes(text)
    monkeypatch.setattr(W, "PIECE", 37)
    assert (W.word_hashes(text) == whole).all()
    assert (W.batch_word_hashes([text, "a"])[0] == whole).all()


def test_shingles_of_short_texts_are_whole_sequences():
    two, three = W.word_hashes("a b"), W.word_hashes("a b c")
    assert len(W.shingles(two, 3)) == len(W.shingles(three, 3)) == 1
    assert W.shingles(two, 3)[0] != W.shingles(three, 3)[0]
    assert len(W.shingle_set(W.word_hashes("a b a b a b"), 2)) == 2


def test_symbol_runs_are_words_of_their_own():
    split = W.word_hashes("one&&&two", W.WORDS_AND_SYMBOLS)
    assert (split == W.word_hashes("one &&& two")).all()
    assert split.dtype == np.uint64
