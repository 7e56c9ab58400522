"""A byte-level BPE file read by the tokenizers library, with a bounded memory of words and pre-tokens.

Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row. A single space between
two other characters always starts a pre-token, so a text splits there into words that are encoded on their own. Words
and pre-tokens that were seen before are looked up; new pre-tokens go to the library's model. Texts with characters outside
a plain set, on which regular expression engines might differ, go to the library whole, as do texts with the string of an
added token, and all texts if the file asks for other steps.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Letters, digits and white space of the plain set; the pre-token pattern of byte-level BPE restricted to it.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = " \t\n\r"
PLAIN = re.compile(f"[{_SPACE}!-~¡-¬®-ɏ‐-‧‰-⁞€]*")
PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words and pre-tokens remembered per process, the longest that are, and the misses, in memories, after which it starts anew.
WORDS, PRETOKENS, LONGEST, AGED = 900_000, 300_000, 64, 8

_open: dict[str, PretokenEncoder] = {}


def _byte_characters() -> dict[int, int]:
    """Byte-level BPE's table: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class _Words(dict):
    """Ids of plain words with the space before them; a word that is missing is encoded."""

    __slots__ = ("by_pattern", "ends", "new", "owner", "tokenize")

    def __init__(self, owner: PretokenEncoder) -> None:
        self.owner, self.tokenize, self.new, self.by_pattern = owner, owner.tokenize, owner._new, owner._by_pattern
        self.ends = {c: owner._new(c) for c in ".,"}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token
            out = array("I", [t.id for t in self.tokenize("\u0120" + word)]).tobytes() if word.isascii() else self.new(" " + word)
        else:
            stem, end = word[:-1], word[-1:]
            out = self[stem] + self.ends[end] if end in self.ends and stem.isalpha() else self.by_pattern(" " + word)
        if len(self) < WORDS:
            if len(word) <= LONGEST:
                self[word] = out
        else:
            self.owner.missed += 1
            if self.owner.missed > AGED * WORDS:  # the corpus has moved on
                self.clear()
                self.owner.pretokens.clear()
                self.owner.missed = 0
        return out


def _splits_as_expected(path: str) -> bool:
    """Whether the file's steps are those of PRETOKEN and nothing else: no normaliser, byte-level pre-tokens, plain BPE."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    before, model = found.get("pre_tokenizer") or {}, found.get("model") or {}
    return (
        not found.get("normalizer")
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback"))
    )


class PretokenEncoder:
    """ids(text) gives a text's ids as little-endian unsigned 32-bit integers: those of the library with the file as it is."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.plain = PLAIN.fullmatch if _splits_as_expected(path) else lambda text: None
        #: Strings that the library takes out of a text before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.characters = _byte_characters()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each id: a byte-level piece has one character per byte, an added token is text.
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.n_bytes[i] = len(piece.encode()) if piece in self.added else len(piece)
        self.pretokens: dict[str, bytes] = {}
        self.missed = 0
        self.words = _Words(self)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, pretoken: str) -> bytes:
        if pretoken.isascii() and pretoken.isprintable():  # only the space has another character
            shown = pretoken.replace(" ", "\u0120")
        else:
            shown = pretoken.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _by_pattern(self, text: str) -> bytes:
        known, out = self.pretokens, b""
        for x in PRETOKEN.findall(text):
            got = known.get(x)
            if got is None:
                got = self._new(x)
                if len(known) < PRETOKENS and len(x) <= LONGEST:
                    known[x] = got
            out += got
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text) or any(x in text for x in self.added):
            return self.library(text)
        if "  " in text:
            return self._by_pattern(text)
        head, *rest = text.split(" ")
        return self._by_pattern(head) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> PretokenEncoder:
    """The process's encoder of that file."""
    if path not in _open:
        _open[path] = PretokenEncoder(path)
    return _open[path]
