"""Token ids of whole texts, with each distinct piece of text encoded once per worker.

Both vocabularies split a text at white space before they merge anything, so a text's ids are
those of its pieces one after another, where a piece is a run of blanks and line feeds with the
characters up to the next one.  Workers keep the ids of pieces they have met (a bounded
number).  A text that holds any other white space or the start of a special token is encoded as a whole;
this is looked for in new pieces only, as no such piece is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from tokenizers import Tokenizer

#: Pieces kept by a worker for each vocabulary, besides as many older ones, of which those met again stay.
KEPT_PIECES = 400_000
#: Runs of signs kept by a worker.
KEPT_ENDS = 20_000

_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]|<\|").search
#: Letters whose lower case is one letter each and that are already composed: pieces of these need no normaliser.
#: Signs after letters, and a line feed before them, are always split off (an apostrophe or underscore is not).
_PLAIN = re.compile(r"([ \n]?)([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([!-&(-/:-@\[-^{-~]*)").fullmatch


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next letter from 256."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class _Whole(Exception):
    """A piece from which follows that its text has to be encoded as a whole."""


class _Kept(dict):
    """The ids of pieces; those of a new piece are found when it is asked for."""

    def __init__(self, new: Callable[[str], bytes]):
        super().__init__()
        self.new = new

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.new(piece)
        return ids


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids.

    ``plain``: strings of special tokens inside a text are ordinary text; else each gives its special id,
    as the tokenizer does when nothing is set.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.kept = _Kept(self._new)
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.ends = {"": b""}
        self.blank = chr(self.letters[32])

    def whole(self, text: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _packed(self, shown: str) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.model.tokenize(shown)])

    def _new(self, piece: str) -> bytes:
        if piece in self.older:
            return self.older[piece]
        if _OTHER_SPACE(piece):
            raise _Whole
        plain = _PLAIN(piece)
        if not plain:
            return self.whole(piece)
        before, letters, signs = plain.groups()
        if before == "\n":
            return self._end(before) + (self._kept(letters) or self._letters("", letters)) + self._end(signs)
        return (signs and self._kept(before + letters) or self._letters(before, letters)) + self._end(signs)

    def _kept(self, piece: str) -> bytes | None:
        return self.kept.get(piece) or self.older.get(piece)

    def _letters(self, space: str, letters: str) -> bytes:
        if self.lower:
            space, letters = "", letters.lower()
        if letters.isascii():  # each letter stands for itself
            return self._packed(self.blank + letters if space else letters)
        return self._packed((space + letters).encode().decode("latin-1").translate(self.letters))

    def _end(self, text: str) -> bytes:
        """The ids of a run of signs, of which there are few, or of a line feed."""
        if text not in self.ends:
            if len(self.ends) > KEPT_ENDS:
                return self.whole(text)
            self.ends[text] = self.whole(text)
        return self.ends[text]

    def ids(self, text: str) -> bytes:
        if len(self.kept) > KEPT_PIECES:
            self.older, self.kept = self.kept, _Kept(self._new)
        try:
            return b"".join(map(self.kept.__getitem__, _PIECES(text)))
        except _Whole:
            return self.whole(text)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(str(Path(path)), plain)
    return _encoders[path, plain]
