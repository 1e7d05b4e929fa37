from hypothesis import given
from hypothesis import strategies as st

from stacksift.functions import text as T


def test_tokens():
    assert T.tokens("Żółw příliš") == ["zolw", "prilis"]
    assert [len(t) for t in T.tokens("a" * 30)] == [24, 6]
    assert len(T.tokens("ノルウェイの森")) == 6
    assert T.tokens("Ｈａｒｒｙ 猫") == ["harry", "猫"]


@given(st.text(max_size=40))
def test_tokens_fold_once(text):
    once = T.fold(text)
    assert T.fold(once) == once


def test_osa():
    assert T.osa("hobit", "hobbit") == 1
    assert T.osa("dnue", "dune") == 1
    assert T.osa("dune", "dune") == 0
    assert T.osa("abc", "xyzuvw") == 3


def test_isbn():
    for good in ("9780439023481", "978-0-439-02348-1", "0439023483"):
        assert T.isbn13(good) == "9780439023481"
    assert T.isbn13("9780439023482") is None
    assert T.isbn13("978-3-8339-1131-6") == "9783833911316"


def test_repaired():
    assert T.repaired("cafÃ©") == "café"
    assert T.repaired("café") == "café"


def test_sentences():
    assert T.sentences("Dr. Who came. He left!") == [(0, "Dr. Who came."), (14, "He left!")]
    assert T.sentences("") == []


def test_dialogue():
    assert [k for _, k, _ in T.dialogue('He said "come here, now." and "left"')] == ["narration", "speech", "narration", "scare"]


def test_bpe():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4}
    assert T.bpe(b"abcab", ranks) == [4, 3]


def test_fnv():
    assert T.fnv1a64(b"") == 0xCBF29CE484222325
    assert T.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
