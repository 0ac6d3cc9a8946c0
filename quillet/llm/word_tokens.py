"""Whole-text encoding through a tokenizer that drops white space, word by word.

The tokenizer's splitting never crosses ASCII white space, so the ids of a text
are the ids of its words one after another. Words repeat, so their packed ids
are kept in a bounded table in each Python worker.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

from quillet.llm.worker_tables import claim, register

#: Words kept by a worker, cores and marks kept by it, and the longest of them.
KEPT_WORDS = 250_000
KEPT_PARTS = 50_000
KEPT_LENGTH = 48

#: Marks that end a word without being part of a contraction.
_MARKS = ".,!?;:|*#$%&)"

#: The sign for each byte in byte-level vocabularies: itself if it prints, else the next one from U+0100 on.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = [chr(b) if b in _PRINTS else chr(0x100 + b - len([p for p in _PRINTS if p < b])) for b in range(256)]

#: Goes before special tokens among words, which never hold it.
_SPECIAL = "\n"

_marks_meet = re.compile(r"(?:[^\w ]|_)[.,] ")
_loaded: dict[str, WordTokenizer] = {}
register("word tokens", _loaded.clear)


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokenizer.encode_special_tokens = True  # texts are cut at special tokens as they stand, so a word like one (once lower-cased) isn't one
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> WordTokenizer:
        """The tokenizer of this worker for ``path``."""
        claim("word tokens")
        if path not in _loaded:
            _loaded[path] = WordTokenizer(path)
        return _loaded[path]

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0300" and word == word.lower():  # one piece, as it stands
            return _packed([t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(_BYTE_SIGNS.__getitem__, word.encode())))])
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode_word(self, word: str) -> bytes:
        """Ids of a word; those of its lower-cased core and of the marks after it, where these don't depend on each other.

        They don't where the core ends with a letter or digit (the marks are then
        pieces of their own) and all characters are below U+0300 (lower case then
        depends on single characters, and nothing composes).
        """
        if word.isalpha():
            return self._ids(word)
        if word.startswith(_SPECIAL):
            return _packed([self.special[word[1:]]])
        core = word.rstrip(_MARKS)
        key = core.lower()
        if len(core) == len(word) or not key or not key[-1].isalnum() or max(key) >= "\u0300":
            return self._ids(word)
        return self._part(key) + self._part(word[len(core) :])

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.known.get(part) or self._ids(part)
            if len(part) <= KEPT_LENGTH:
                self.parts[part] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        """Words of a text and, marked, its special tokens."""
        words, at = [], 0
        for m in self.specials.finditer(text):
            words += _split(text[at : m.start()])
            words.append(_SPECIAL + m.group())
            at = m.end()
        return words + _split(text[at:]) if at else _split(text)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        split = [self._words(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > KEPT_WORDS:  # keep what is in use
            self.known = {w: ids for w in used if (ids := self.known.get(w)) is not None}
        if len(self.parts) > KEPT_PARTS:
            self.parts = {}
        known = self.known
        new = used.difference(known)
        for word in new:
            known[word] = self.encode_word(word)
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        for word in new:
            if len(word) > KEPT_LENGTH:
                del known[word]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _split(text: str) -> list[str]:
    """Words of a text; where that can't change an id, in lower case and with full stops and commas apart."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
    try:
        text.encode("latin-1")  # then lower case depends on single characters, and nothing composes
    except UnicodeEncodeError:
        return text.split(" ")
    text = f"{text.lower()} "
    if not _marks_meet.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")
