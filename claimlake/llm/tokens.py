"""Token ids of whole texts by the tokenizers library, one library call per new word.

Where a vocabulary lower-cases, and its normaliser and splitter never join characters across an
ASCII blank, a text's ids are its words' ids in order. Words repeat; their ids are kept (up to
LIMIT words a worker, later ones are encoded each time they come). Whether that holds is tried
on PROBES when a vocabulary is loaded; with one where it doesn't, whole texts go to the library.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

from claimlake.llm.text import chunks

LIMIT = 1_000_000
LONG = 64
#: Words that normaliser and splitter leave alone: one piece, lower case, composed.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


#: Texts that the short way must encode as the library does.
PROBES = (
    "Hello World, it's 3.14 of the Words. And words, more words; words.",
    "  two  blanks\n\nlines\tand a tab\r\n",
    "Ünïcode ÑANDÚ straße Straße café Café, naïve.",
    "1234567 x1y2 a-b_c @home #tag 50% $9.99 (in) [out] {on}",
    "don't we'll THEY'RE I'm you've he'd",
    "漢字 and кириллица, Ελληνικά; עברית. 😀 end",
    "A,B.C, d.e , f . G",
    "word word, word. Word, Word.",
    "special <|endoftext|> text and <s> marks </s>",
    "internationalisation antidisestablishmentarianism aaaaaaaaaaaaaaaaaaaaaaaa",
)


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self[""] = b""
        self.by_word = True
        try:
            # Latin-1 letters as the byte-level alphabet writes their two UTF-8 bytes
            self.letters = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
            self.by_word = all(self.encode(t) == self._whole(t) for t in PROBES)
        except (AttributeError, IndexError):
            self.by_word = False

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return _bytes([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
        return self._whole(word)

    def __missing__(self, word: str) -> bytes:
        # Letters and a following comma or stop are split by the vocabulary's pattern, so a new
        # word can use a known one's ids. It takes an entry of its own if that one came before.
        if len(word) > 1 and word[-1] in ",." and word[-2].isascii() and word[-2].isalpha():
            keep = word[:-1] in self
            ids = self[word[:-1]] + self[word[-1]]
        else:
            keep, ids = len(word) <= LONG, self._encode(word)
        if keep and len(self) < LIMIT:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        parts = [b"".join(map(self.__getitem__, _lower(c).replace("\n", " ").split(" "))) for c in chunks(text)]
        return parts[0] if len(parts) == 1 else b"".join(parts)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _lower(text: str) -> str:
    """Latin-1 text in lower case, as the vocabulary's normaliser does anyway; other text as it is.

    Special tokens, which begin with <|, are matched before the normaliser and stay.
    """
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table a worker process."""
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
