"""Token ids of whole texts by a public word-level BPE vocabulary, with a bounded word cache.

The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``. That
vocabulary's rules (NFC, lower case, white space dropped, pieces of letters, single
digits and runs of signs) never cross white space, so ids are looked up word by word;
only words not met lately go through the tokenizer's BPE. Texts with
characters on which Python's rules and the tokenizer's may differ are encoded whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

#: Words in each of the two generations of the cache.
CACHE_WORDS = 250_000

#: Characters on which Python's rules and the vocabulary's differ: separators to split() only, two letters by lower case, some marks, and the start of special tokens.
_ODD = re.compile("[\x1c-\x1fΣİ\u180e\u200b\u2060\ufeff]|<\\|")
_ODD_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_PLAIN = re.compile("[!-~¡-±´-¸»¿-ɏ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: itself if printable, else the next one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Word to ids. Words that the current generation lacks come from the last one or from the tokenizer."""

    def __init__(self, whole, last: dict) -> None:
        self.whole, self.model, self.last, self.letters = whole, whole.model, last, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.last.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.piece(word)
            elif word[-1] in ".,;:!?" and word[:-1].isalpha():
                ids = self.piece(word[:-1]) + self[word[-1]]
            elif _PLAIN.fullmatch(word):
                ids = b"".join([self.piece(p) for p in _PIECES.findall(word)])
            else:
                ids = _bytes(self.whole.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            letters = self.letters
            piece = "".join([letters[b] for b in piece.encode()])
        return _bytes([t.id for t in self.model.tokenize(piece)])


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache = _Cache(self.whole, {})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self._one(text) if text else b"" for text in texts]
        if len(self.cache) > CACHE_WORDS:
            last, self.cache.last = dict(self.cache), {}
            self.cache = _Cache(self.whole, last)
        return out

    def _one(self, text: str) -> bytes:
        if text.isascii():
            odd = any(x in text for x in _ODD_ASCII)
        else:
            odd = _ODD.search(text) is not None
            text = text if odd else unicodedata.normalize("NFC", text)
        if odd:
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.cache.__getitem__, text.lower().split()))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One cache for each worker process and vocabulary."""
    return WordIds(path)
