"""The tokenizers library over whole texts, word by word, with a bounded memory of words.

A text is cut before white space that follows another character. The splitting patterns of the
vocabularies here never join characters across such a cut, so the ids of the parts, put together, are
those of the text; most parts repeat, and the library sees each one once per worker. A text that holds the
name of an added token (such as <|endoftext|>), which the library gives its own id, goes to it whole.
"""

from __future__ import annotations

import gc
import os
import re
import string
import unicodedata
from array import array

import numpy as np

from duochron.llm.common import WHITE_SPACE

#: Words kept per worker (about 150 MB), and the longest that is kept.
KEEP, KEEP_CHARS = 500_000, 48

#: A word that ends with a run of these after a letter is its stem and that run: no vocabulary here joins them.
#: The apostrophe isn't here, as it joins with letters.
TAIL = "".join(c for c in string.punctuation if c != "'")
#: Runs kept per worker, and the longest that is kept.
KEEP_TAILS, TAIL_CHARS = 10_000, 8

#: Letters below this have no other normal form.
LATIN = "\u0250"
#: Byte-level vocabularies show the bytes that are no visible Latin-1 character as those from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

_W = f"[{WHITE_SPACE}]"
_CHUNKS = re.compile(f"{_W}*[^{WHITE_SPACE}]+|{_W}+").findall
_WORDS = re.compile(f"[^{WHITE_SPACE}]+").findall
#: str.split() also splits at these, which aren't white space to the libraries.
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: White space in a row, and white space other than space and line end.
_ROWS = ("  ", "\n\n", " \n", "\n ")
_OTHERS = "".join(c for c in WHITE_SPACE if c not in " \n")


def _odd(text: str) -> bool:
    """Whether white space is at an end, in a row, or other than space and line end; substring searches are far faster than a pattern."""
    return not text or text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _ROWS) or any(c in text for c in _OTHERS)


def _ends(letter: str) -> bool:
    """Whether this letter still ends in a letter once normal form and lower case have been taken."""
    return letter.isalpha() and (letter.isascii() or unicodedata.normalize("NFC", letter).lower()[-1].isalpha())


_loaded: dict[tuple[str, bool], "WordCache"] = {}


class _Seen(dict):
    """Word -> the bytes of its ids after ``lead``; what is missing is looked up, and kept while there is room.

    A word that is made of another (its stem) is kept from the second time the stem is met, so that words
    that occur once take one place.
    """

    def __init__(self, cache: "WordCache", lead: str = ""):
        super().__init__()
        self.cache, self.lead = cache, lead

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(TAIL)
        if stem and stem != word and _ends(stem[-1]):
            tail = self.cache.tails[word[len(stem) :]]
        else:
            stem, tail = word, b""
        if not self.cache.spaces:
            stem = stem.lower() if stem.isascii() else self.cache.small(stem)
        if stem == word:
            ids = self.cache.ask_word(self.lead, word)
        elif (ids := self.get(stem)) is None:
            return self[stem] + tail
        else:
            ids += tail
        if len(self) < KEEP and len(word) <= KEEP_CHARS:
            self[word] = ids
        return ids


class _Tails(dict):
    """A run of marks -> the bytes of its ids."""

    def __init__(self, cache: "WordCache"):
        super().__init__()
        self.cache = cache

    def __missing__(self, tail: str) -> bytes:
        ids = self.cache.ask(tail)
        if len(self) < KEEP_TAILS and len(tail) <= TAIL_CHARS:
            self[tail] = ids
        return ids


class WordCache:
    """spaces: whether white space itself has ids (byte-level vocabularies) or is dropped, with letters lower-cased."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # of words; see named()
        self.path, self.whole = path, None
        self.added = [(t.content[:2], t.content.lower()) for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.spaces = spaces
        self.tails = _Tails(self)
        self.bare, self.spaced = _Seen(self), _Seen(self, " ")
        self.line = self.ask("\n") if spaces else b""

    @classmethod
    def of(cls, path: str, spaces: bool) -> "WordCache":
        if (path, spaces) not in _loaded:
            _loaded[path, spaces] = cls(path, spaces)
        return _loaded[path, spaces]

    def ask(self, text: str) -> bytes:
        return array(self.code, self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def named(self, text: str) -> bool:
        """Whether an added token may be in the text; some vocabularies look for them in lower case."""
        return any(start in text for start, _ in self.added) and any(name in text.lower() for _, name in self.added)

    def ask_whole(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ask_word(self, lead: str, word: str) -> bytes:
        """A word of Latin letters is one match of the splitting patterns, which goes to the library's model as it is."""
        if word.isascii():
            latin = word.isalpha()
        else:
            latin = word.isalpha() and max(word) < LATIN and (self.spaces or word == word.lower())
        if not latin:
            return self.ask(lead + word)
        said = lead + word
        if lead or not word.isascii():
            said = said.encode().decode("latin-1").translate(_SHOWN)
        return array(self.code, [t.id for t in self.model.tokenize(said)]).tobytes()

    def small(self, word: str) -> str:
        """The word in lower case if that is what the library makes of it, letter by letter; else the word."""
        low = word.lower()
        return low if low.isalpha() and len(low) == len(word) and max(word) < LATIN else word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of ``dtype``."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and passes over the memory of words cost more than the lookups
        try:
            return [self.ask_whole(t) if self.named(t) else self._plain(t) if self.spaces and not _odd(t) else self._any(t) for t in texts]
        finally:
            if collecting:
                gc.enable()

    def _any(self, text: str) -> bytes:
        if self.spaces:
            words = _CHUNKS(text)
        else:
            words = _WORDS(text) if any(c in text for c in _CONTROLS) else text.split()
        return b"".join(map(self.bare.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        """A text whose white space is single spaces and line ends between other characters."""
        bare, spaced = self.bare, self.spaced.__getitem__
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(bare[first])
            out += map(spaced, rest)
            out.append(self.line)
        out.pop()
        return b"".join(out)
