"""Workers' caches over the public tokenizer libraries: each distinct unit of text is encoded once while it is held.

The place of the vocabulary files is a parameter; a bare file name is looked up in the
folder of the installed public vocabularies.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

LONGEST_HELD = 64            # characters of a unit that a cache may hold
MOST_HELD = 400_000          # units in a cache; a full cache starts anew


def file_of(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """A tokenizers library tokenizer, one per worker and file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(file_of(name))
    made.no_truncation()
    made.no_padding()
    return made


def chunks(texts: list[str], size: int = 1 << 19):
    """(place of the first, texts) of successive texts of about `size` characters in all."""
    at = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield at, texts[at:i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class Cache(dict):
    """unit -> what `make(unit)` gave; units over LONGEST_HELD characters are made each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str):
        made = self.make(unit)
        if len(unit) <= LONGEST_HELD:
            self[unit] = made
        return made

    def all_of(self, units: list[str]):
        """The values of the units, in order."""
        if len(self) > MOST_HELD:
            self.clear()
        return map(self.__getitem__, units)


class Generations:
    """token -> what `make(token)` gave, in two generations of a bounded number of tokens: a full newer one becomes the older, and what is asked for again comes back. So frequent tokens stay."""

    def __init__(self, make, most: int = 500_000):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def of(self, tokens: set[str]) -> dict:
        """A dictionary with at least these tokens, until the next call."""
        if len(self.new) > self.most // 2:
            self.old, self.new = self.new, {}
        lacking = tokens - self.new.keys()
        again = lacking & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        lacking -= again
        self.new.update(zip(lacking, map(self.make, lacking)))
        if any(len(t) > LONGEST_HELD for t in lacking):            # not to be held: the next call starts without them
            held, self.new = self.new, {t: v for t, v in self.new.items() if len(t) <= LONGEST_HELD}
            return held
        return self.new


ODD_SPACE = re.compile("[\x1c-\x1f]")      # blanks to Python, symbols to the tokenizer's patterns


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and so on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


LETTERS = byte_letters()


def as_letters(token: str) -> str:
    """A pre-token in the byte-level alphabet."""
    return token.encode().decode("latin-1").translate(LETTERS)


#: White space, printable ASCII and the Latin letters up to U+017F that are their own composed form and have one small letter.
LATIN_TEXT = re.compile("[ \t-\r!-~À-ÖØ-öø-įĲ-ňŊ-ž]*")
#: Fixed value: the pre-token pattern of the word tokenizer, here for such text in lower case.
LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")


class Words:
    """The library's own steps (normalise, cut, merge) with a cache of pre-tokens. Texts in Latin letters are cut as a whole; others by the library, each unit without white space once while it is held."""

    def __init__(self, name: str):
        self.library = tokenizer(name)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self.library.model.tokenize
        self.tokens = Generations(self._token)
        self.units = Cache(self._unit)

    def _token(self, token: str) -> bytes:
        ids = [t.id for t in self.merge(token if token.isascii() else as_letters(token))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))
        ids = [i.id for t, _ in cut for i in self.merge(t)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: those of its words, one after the other, as nothing is joined over white space."""
        cut = [LATIN_WORD.findall(t.lower()) if LATIN_TEXT.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        known = self.tokens.of(set().union(*[c for c in cut if c]))
        return [np.frombuffer(b"".join(map(known.__getitem__, c)), "<u4") if c is not None else self._other(t) for c, t in zip(cut, texts)]

    def _other(self, text: str) -> np.ndarray:
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(self.units.all_of(text.split())), "<u4")


@lru_cache(maxsize=4)
def _words(name: str) -> Words:
    return Words(name)


def word_ids(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids of each text by a lower-casing tokenizer that drops white space, without added special tokens."""
    return _words(name).ids(texts)
