"""Whole-text encoding with the tokenizers library, cached by word.

Merges never cross a pre-token, so a text's ids are the ids of its pre-tokens
in order.  ``Encoder`` cuts a text at spaces, keeps the ids of words that it
has met, cuts a new word into the tokenizer's own pre-tokens and asks the
library's model for those that it hasn't met.  Texts for which a cut at spaces
could differ from the library's own (runs of white space, control characters,
letters that normalisation may change) are given to the library whole.  Both
ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` with
``encode_special_tokens``: strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import os
from array import array

import numpy as np

from .memory import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and pre-tokens that an encoder remembers; beyond, it forgets all and starts again.
REMEMBERED = 600_000
#: Those of them that stay when a task ends, as its process may be kept for other work.
KEPT = 50_000
#: Longer words are not remembered.
LONGEST = 64

_MARKS = frozenset(".,;:!?")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, the
    others, in order, for the code points from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Irregular(Exception):
    """Two spaces in a row, or white space at an end: the cut at spaces isn't sure."""


class _Known(dict):
    """Ids by word; a word that is not there is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def shrink(self) -> None:
        """Keep the first KEPT, which frequent words are among."""
        if len(self) > KEPT:
            first = list(itertools.islice(self.items(), KEPT))
            self.clear()
            self.update(first)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.cut = regex.compile(_WORD_PATTERN if self.lower else public_tokenizers.PATTERN).findall
        letters = _byte_letters()
        self.ascii = str.maketrans({b: letters[b] for b in range(128)})
        self.letters, self.space = letters, letters[0x20]
        self.pretokens = _Known(self._pretoken)
        self.words = _Known(self._word if self.lower else self._spaced)
        self.heads = _Known(self._unspaced)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        """Ids of a pre-token that is written in byte letters."""
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _pretoken(self, token: str) -> bytes:
        return self._ids(token.translate(self.ascii) if token.isascii() else "".join(map(self.letters.__getitem__, token.encode())))

    # Letters alone are one pre-token, and a mark after them is one more: most words
    # need no cut, and a word with a mark needs no ids of its own.

    def _word(self, word: str) -> bytes:
        """A word between white space, for tokenizers that drop white space."""
        if word.isalpha():
            if word.isascii():
                return self._ids(word.lower())
            if max(word) < "\u0130":
                return self._ids("".join(map(self.letters.__getitem__, word.lower().encode())))
        elif word[-1] in _MARKS and word[:-1].isalpha() and max(word) < "\u0130":
            return self.words[word[:-1]] + self.pretokens[word[-1]]
        if word.isascii() or max(word) < "\u0130":
            return b"".join(map(self.pretokens.__getitem__, self.cut(word.lower())))
        return self.whole(word)

    def _unspaced(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return self._cut(word)

    def _spaced(self, word: str) -> bytes:
        """A word with the space before it."""
        if word.isalpha():
            if word.isascii():
                return self._ids(self.space + word)
            if max(word) < "\u0130":
                return self._ids(self.space + "".join(map(self.letters.__getitem__, word.encode())))
        elif word[-1:] in _MARKS and word[:-1].isalpha() and max(word) < "\u0130":
            return self.words[word[:-1]] + self.pretokens[word[-1]]
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return self._cut(" " + word)

    def _cut(self, word: str) -> bytes:
        if (word.isascii() or max(word) < "\u0130") and word.replace("\n", "").isprintable():
            return b"".join(map(self.pretokens.__getitem__, self.cut(word)))
        return self.whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.lower:
            if any(c in text for c in _SEPARATORS):  # white space for Python only
                return self.whole(text)
            return b"".join(map(self.words.__getitem__, text.split()))
        head, *rest = text.split(" ")
        try:
            return self.heads[head] + b"".join(map(self.words.__getitem__, rest))
        except _Irregular:
            return self.whole(text)


_ENCODERS: dict[str, Encoder] = {}


def shrinking(run):
    """A task's function whose encoders forget most words when it ends; what is free is given back."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for e in _ENCODERS.values():
                for known in (e.words, e.heads, e.pretokens):
                    known.shrink()
            give_back()

    return task


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """One encoder of a path for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
