"""Token ids of the word-end BPE vocabulary, word by word.

This vocabulary's tokenizer lower-cases, drops white space and never joins tokens over
it, so a text's ids are its words' ids in a row, and a worker keeps the ids of words it
has met. Texts with letters outside Latin-1 and Latin Extended-A, with unusual control
characters or with a special token's string go through the tokenizer itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
KNOWN_WORDS = 400_000

_UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ſ]")


def _of_category(letter: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == letter)


#: Fixed value: the vocabulary's split pattern, with its letters and numbers up to U+017F.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+".format(
    L=_of_category("L"), N=_of_category("N")))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._letters = _byte_letters()
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) >= KNOWN_WORDS:
                self._pieces.clear()
            letters = piece.encode().decode("latin1").translate(self._letters)
            found = np.array([t.id for t in self._tokenizer.model.tokenize(letters)], "<u4").tobytes()
            self._pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= KNOWN_WORDS:
                self._words.clear()
            found = b"".join(map(self._piece, _SPLIT.findall(word)))
            self._words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text) or any(s in text for s in self._special):
            return self._whole(text)
        return b"".join(map(self._word, text.lower().split()))


@lru_cache(maxsize=2)
def word_ids(path: str | None = None) -> WordIds:
    """One per worker process."""
    return WordIds(path or public_tokenizers.path(VOCABULARY))
