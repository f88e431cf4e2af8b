"""Encoding with a library tokenizer that drops white space, piece by piece.

Such a tokenizer never joins characters across a space or a line feed, so these
two are safe boundaries: a text's ids are those of its pieces, one after the
other.  Distinct pieces are encoded once per worker and memoised under a fixed
bound; a text is never cut anywhere else, and no part of it is left out.  Samples
tell at load whether a tokenizer is of this kind; texts of another kind are
encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np

from .common import held

#: Pieces longer than this are encoded each time and not kept.
LONGEST_KEPT = 256
#: Distinct pieces kept by a worker, twice this at most.
KEPT = 500_000
SAMPLES = ("a", "the", "tion", "onthat", "encyclopedias", "zqxjkv", "s", "ll", "mnbvcxzasdf" * 5)
#: Texts whose ids show whether a tokenizer may be given pieces, and cores and marks apart.
SPACED = ("a b", "the  quick\nbrown \n fox", " lead and trail ", "Don't stop, now. 3.5 and 1,000 É", "\t tab\r\nline")
MARKED = ("Word,", "WORD.", "x9,", "Ab.", "CamelCase.", "Don't,", "100.")
#: Marks that may follow a word.
TAILS = (",", ".")
#: A text longer than this is worked on in segments.
SEGMENT = 1 << 18


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def segments(text: str, limit: int = SEGMENT):
    """``text`` cut after a space or line feed into segments of about ``limit`` characters."""
    if len(text) <= limit:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text):
            cuts = [c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0]
            end = min(cuts) + 1 if cuts else len(text)
        yield text[at:end]
        at = end


def pieces_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def parted(piece: str) -> tuple[str, str]:
    """A piece's core and the mark after it.

    A mark after a letter or digit is a word of its own to the tokenizer, and it
    lowers letters first, so "Word," is "word" and ",".  Not so beside "<|",
    where a special token may stand.
    """
    if piece.isascii() and "<|" not in piece:
        piece = piece.lower()
        if piece[-1:] in TAILS and piece[-2:-1].isalnum():
            return piece[:-1], piece[-1]
    return piece, ""


class PieceEncoder(dict):
    """Pieces to a value of their encoding, memoised in two generations.

    When the young generation is full it becomes the old one and the old one
    goes, so frequent pieces stay and memory has a fixed bound.
    """

    def __init__(self, path: str, value_of: Callable, kept: int = KEPT):
        """value_of: from the tokenizer to a function from a list of ids to a value that can be added up."""
        super().__init__()
        self.tokenizer, self.kept = load_tokenizer(path), kept
        self.value_of = value_of(self.tokenizer)
        self.old: dict = {}
        self.model = self.tokenizer.model.tokenize
        # white space ends a word and has no ids of its own
        self.spaced = all(self.ids(t) == [i for p in pieces_of(t) for i in self.ids(p)] for t in SPACED) and not self.ids(" ")
        self.marked = self.spaced and all(self.ids(p) == [*self.ids(c), *self.ids(t)] for p in MARKED for c, t in [parted(p)])
        # a lower-case ASCII word needs no normalisation and no split, if these show that it is so
        self.direct = self.spaced and all([t.id for t in self.model(w)] == self.ids(w) for w in SAMPLES)
        self.tails = {t: self.encode(t) for t in TAILS}

    def ids(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, piece: str):
        if self.direct and piece.isascii() and piece.isalpha() and piece.islower():
            return self.value_of([t.id for t in self.model(piece)])
        return self.value_of(self.ids(piece))

    def parted(self, piece: str) -> tuple[str, str]:
        return parted(piece) if self.marked else (piece, "")

    def pieces(self, text: str) -> list[list[str]]:
        """The pieces of a text, segment by segment; the text itself if it can't be cut."""
        return [pieces_of(part) for part in segments(text)] if self.spaced else [[text]]

    def encode_batch(self, pieces: set[str]) -> None:
        """Encodes those of ``pieces`` that aren't held, as one batch."""
        todo = list({c for p in pieces if p not in self for c in [self.parted(p)[0]] if len(c) <= LONGEST_KEPT and c not in self and c not in self.old})
        for piece, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)):
            self[piece] = self.value_of(e.ids)

    def __missing__(self, piece: str):
        """The value of a piece that isn't held, by way of its core."""
        core, tail = self.parted(piece)
        value = self.get(core)
        if value is None and (value := self.old.get(core)) is None:
            value = self.encode(core)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[core] = value
            if core != piece:
                value = self[piece] = value + self.tails[tail] if tail else value
        elif tail:
            value = value + self.tails[tail]
        return value

    def values(self, pieces: list[str]) -> list:
        """The values of pieces, in order."""
        return list(map(self.__getitem__, pieces))


def id_type(tokenizer) -> np.dtype:
    """Of ids in files; workers write their machine's byte order, little-endian on all that Spark's native parts support."""
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def length_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of pieces to numbers of ids."""
    return held(("lengths", path), lambda: PieceEncoder(path, lambda tokenizer: len))


def id_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of pieces to the bytes of their ids, of type id_type."""

    def packed(tokenizer) -> Callable:
        code = "H" if id_type(tokenizer).itemsize == 2 else "I"
        return lambda ids: array(code, ids).tobytes()

    return held(("ids", path), lambda: PieceEncoder(path, packed))
