"""Byte-level BPE ids through the tokenizers library, with a bounded cache.

The pre-tokenizer of the vocabulary file never joins text across a blank that
is followed by a character other than white space, so a text's ids are those
of its parts between such blanks.  Parts repeat, so their ids are kept; a part
not met before is cut by the file's pattern and each piece goes to the
library's model.  Parts with characters outside the Latin blocks, and texts that
hold the string of a special token, go to the library whole.  (The tests compare
this with the library's plain call on the whole text.)
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

VOCABULARY = "byte_bpe_50k.json"
#: Parts, and pieces of parts, whose ids a process keeps.
CACHE, PIECE_CACHE = 800_000, 400_000
#: The pattern of the byte-level pre-tokenizer (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PARTS, _LOOSE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
_PLAIN = re.compile(" ?[A-Za-z]+")
#: A word of plain letters and the signs after it (no apostrophe): two pieces.
_WORD_AND_SIGNS = re.compile(r"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
_LATIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u024f]*")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    if it is visible in Latin-1, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces(dict):
    """A piece that the file's pattern cuts -> its ids (little-endian, 16 bits)."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece):
            spelled = piece.replace(" ", "Ġ")
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        found = np.asarray([t.id for t in self.model.tokenize(spelled)], "<u2").tobytes()
        if len(self) < PIECE_CACHE and len(piece) < 64:
            self[piece] = found
        return found


class Encoder(dict):
    """part of a text -> its ids as bytes (little-endian, 16 bits each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.pieces = Pieces(self.tokenizer.model)
        self.cut = regex.compile(PIECES)

    def __missing__(self, part: str) -> bytes:
        plain = _WORD_AND_SIGNS.fullmatch(part)
        if plain:
            word, signs = plain.groups()
            found = self.pieces[word] + self.pieces[signs] if signs else self.pieces[word]
        elif _LATIN.fullmatch(part):
            found = b"".join([self.pieces[x] for x in self.cut.findall(part)])
        else:
            found = np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) < CACHE and len(part) < 64:
            self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):  # the library cuts such texts at these strings first
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        # where no blank is followed by white space, every blank is such a cut
        first, *rest = _PARTS.split(text) if _LOOSE.search(text) else text.split(" ")
        return self[first] + b"".join([self[" " + x] for x in rest])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
