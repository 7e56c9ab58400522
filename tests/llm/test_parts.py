"""Words are encoded in parts that no piece connects; the ids are the library's."""

import random

import numpy as np
from helpers import PIECES

from strataflow.llm.pieces import SPACE, model


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_a_word_and_its_punctuation_are_remembered_apart():
    m = model(PIECES)
    m.words.clear()
    m.encode("Harbour, stone. window!")
    held, missed = len(m.words), m.missed
    for text in ("Harbour. stone! window,", "Harbour! stone, window.", "Harbour stone window"):
        assert ids(m.encode(text)) == m.library.encode(text)
    assert (len(m.words), m.missed) == (held, missed)


def test_parts_make_up_the_text_and_give_the_ids_of_the_library():
    m, rng = model(PIECES), random.Random(5)
    signs = list("abcdeXYZéßñçŁ0123456789.,;:!?'\"()[]{}-_^\\/|#%&*+=<>@~$\t\n ") + ["  ", " ", "ing", "tion", "我", "я", "ا", "🙂", "́", SPACE, "..."]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 60)))
        shown = m.normal(text)
        assert "".join(m.word.findall(shown)) == shown
        assert ids(m.encode(text)) == m.library.encode(text), text


def test_no_piece_goes_over_a_part():
    m = model(PIECES)
    for piece, i in m.trie.items():
        if i >= 0:
            assert m.word.findall(piece) == [piece], piece


def test_cuts_are_the_first_and_last_beginning_of_a_word():
    m, rng = model(PIECES), random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choices(["a", "b", SPACE], [2, 2, rng.choice([0.2, 2, 9])], k=rng.randint(1, 14)))
        begin = rng.randint(0, len(text))
        stop = rng.randint(begin, len(text))
        found = [i for i in range(max(begin, 1), stop) if text[i] == SPACE != text[i - 1]]
        assert m.cuts(text, begin, stop) == ((found[0], found[-1]) if found else None), (text, begin, stop)
