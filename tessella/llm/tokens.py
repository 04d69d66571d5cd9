"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

A byte-level BPE with the usual pattern never merges across the start of a word
that one space precedes, nor across a line break that stands alone. Texts whose
white space is only that are cut there, and each piece's ids come from a cache;
what the cache lacks, and every other text, goes through the library itself, as
do texts that hold an added token's content, and all texts where the file names
another normalizer or pattern.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Ends every document.
END_ID = 2
#: Pieces in a generation of a worker's cache, which holds two (about 150 bytes a piece).
CACHE_PIECES = 350_000
#: Letters, then ASCII marks up to the end: the pattern takes them as two pieces.
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")
#: Begins a piece that stands behind a line break instead of a space.
_BREAK = "\x00"
#: White space that is neither a space nor a line break, and what would be taken for one.
_ASCII_SPACES = _BREAK + "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACES = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def plainly_spaced(text: str) -> bool:
    """Whether all white space is single spaces or single line breaks between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return False
    odd = _ASCII_SPACES if text.isascii() else _ASCII_SPACES + _WIDE_SPACES
    return not any(map(text.__contains__, odd))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes for themselves, the others in order from U+0100 on (a fixed convention)."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """ids of a piece, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, piece: str) -> bytes:
        if piece[:1] == _BREAK:  # not kept: its parts are
            return self.encoder.line_break + self.encoder.first[piece[1:]]
        if len(self) >= self.encoder.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is not None:
            pass
        elif piece.isalpha():
            ids = self.encoder.word(self.lead + piece)
        elif (m := _LETTERS_MARKS.match(piece)) and m[1].isalpha():
            ids = self[m[1]] + self.encoder.marks[m[2]]
        else:
            ids = self.encoder.library(self.lead + piece)
        self[piece] = ids
        return ids


class _Marks(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        ids = self.encoder.library(marks)
        if len(self) < self.encoder.most:
            self[marks] = ids
        return ids


def _byte_level(tokenizer) -> bool:
    """Whether the vocabulary is a byte-level BPE with the usual pattern on texts as they are."""
    said = json.loads(tokenizer.to_str())
    cut = said["pre_tokenizer"] or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(usual) and said["normalizer"] is None and said["model"]["type"] == "BPE" and not said["model"].get("dropout")


class Encoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.usual = _byte_level(self.tokenizer)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.first, self.inner, self.marks = _Pieces(self, ""), _Pieces(self, " "), _Marks(self)
        self.line_break, self.space = self.library("\n"), self.letters[0x20]

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """As ``library``, for letters that at most one space precedes: they are one piece of the pattern."""
        if text.isascii():  # only the space is spelt otherwise
            spelt = self.space + text[1:] if text[0] == " " else text
        else:
            spelt = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """ids of the text and the end id, as little-endian unsigned 32-bit integers."""
        end = END_ID.to_bytes(4, "little")
        if not text:
            return end
        if not self.usual or not plainly_spaced(text) or any(map(text.__contains__, self.added)):
            return self.library(text) + end
        pieces = text.replace("\n", " " + _BREAK).split(" ")
        return self.first[pieces[0]] + b"".join(map(self.inner.__getitem__, pieces[1:])) + end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = CACHE_PIECES) -> Encoder:
    """This process's encoder for a vocabulary file, with room for ``most`` pieces a generation."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
