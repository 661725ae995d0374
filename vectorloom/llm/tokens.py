"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

A byte-level vocabulary's pre-tokenizer always starts a piece at a space before a non-space, so
the ids of a text are the ids of its space-separated units put together. Each worker encodes a
unit once with the library and keeps a table of what it has seen, bounded in bytes. Most of the library's
time for a new unit goes into cutting it into pieces; units of plain Latin characters are cut
here by the same published pattern and only their pieces go to the library's model. Ids are the
same as those of the whole text. Any other kind of vocabulary encodes whole texts. Strings that
spell special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from sys import getsizeof

import numpy as np
import regex

#: Cuts a text where a piece always begins.
_CUT = re.compile(r" (?=\S)")
#: A space that cuts nothing.
_GAP = re.compile(r" (?!\S)")
#: Fixed value: the pattern by which byte-level pre-tokenizers cut texts into pieces.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units whose characters have the same classes in every Unicode version.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]+")


def _byte_characters() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable ones as they are, others from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_SPELLED = _byte_characters()
_SPACE = chr(_SPELLED[ord(" ")])
#: Marks that end a word and never begin a piece with letters, as an apostrophe may.
_MARKS = tuple(".,;:!?)")
#: Bytes of units and of pieces a worker keeps, by their measured sizes; longer units are never
#: kept. A worker's tables take both together, whatever the texts, unless ``Encoder.of`` is given
#: less; the ids are the same.
UNIT_BYTES = 192 << 20
PIECE_BYTES = 72 << 20
MAX_UNIT_CHARS = 64
#: What an entry takes beside its characters and ids: two objects (as sys.getsizeof says) and
#: its place in a table that is on average two thirds full.
ENTRY_BYTES = getsizeof("") + getsizeof(b"") + 104
#: Characters encoded at a time, so that unit lists stay small however long a text is.
STEP_CHARS = 1 << 20

_encoders: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table(dict):
    """Ids by text in at most ``most`` bytes; a full table starts anew. What is missing is made
    by ``make`` when it is looked up."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.held, self.make = most, 0, make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        self.put(text, ids)
        return ids

    def put(self, text: str, ids: bytes) -> None:
        if len(text) > MAX_UNIT_CHARS:
            return
        size = ENTRY_BYTES + len(text) + len(ids)
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size
        self[text] = ids

    def bound(self, most: int) -> None:
        """At most ``most`` bytes from now on; a table that holds more starts anew."""
        self.most = most
        if self.held > most:
            self.clear()
            self.held = 0


class Encoder:
    def __init__(self, path: str, unit_bytes: int = UNIT_BYTES, piece_bytes: int = PIECE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        #: Every id as four bytes.
        size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        self.known = Table(unit_bytes, self._unit)
        self.pieces = Table(piece_bytes, self._piece)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cut, model = made.get("pre_tokenizer") or {}, made["model"]
        self.by_units = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and not made.get("normalizer")
            and model.get("type", "BPE") == "BPE" and not model.get("dropout")
            and not model.get("ignore_merges"))

    @staticmethod
    def of(path: str, table_bytes: int = UNIT_BYTES + PIECE_BYTES) -> Encoder:
        """The worker's encoder; its tables hold at most ``table_bytes`` together."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, whole = _encoders[path], UNIT_BYTES + PIECE_BYTES
        encoder.known.bound(table_bytes * UNIT_BYTES // whole)
        encoder.pieces.bound(table_bytes * PIECE_BYTES // whole)
        return encoder

    def _library(self, units: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            # What stands behind a space may be known as a unit.
            ids = self.known.get(piece[1:]) if piece[0] == " " else None
            if ids is not None:
                return ids
            spelled = piece.replace(" ", _SPACE)
        else:
            spelled = piece.encode().decode("latin-1").translate(_SPELLED)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(spelled)])

    def _unit(self, unit: str, lead: str = " ") -> bytes:
        """Ids of a unit that stands behind ``lead``."""
        if unit.isascii():  # words of letters are one piece by the pattern, a mark another
            if unit.isalpha():
                return self.pieces.get(lead + unit) or self._piece(lead + unit)
            if unit[-1:] in _MARKS and unit[:-1].isalpha():
                return self.pieces[lead + unit[:-1]] + self.pieces[unit[-1]]
        if _PLAIN.fullmatch(unit):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(lead + unit)))
        return self._library([lead + unit])[0]

    def _some(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts (little-endian, 32 bits)."""
        if not self.by_units:
            return self._library(texts)
        units = [_CUT.split(t) if _GAP.search(t) else t.split(" ") for t in texts]
        known = self.known
        others = list({w for t, u in zip(texts, units, strict=True)
                       if not (t.isascii() or _PLAIN.fullmatch(t))
                       for w in u[1:] if len(w) <= MAX_UNIT_CHARS and w not in known
                       and not _PLAIN.fullmatch(w)})
        if others:  # one call of the library for all that can be kept
            for w, ids in zip(others, self._library([" " + w for w in others]), strict=True):
                known.put(w, ids)
        return [self._unit(u[0], "") + b"".join(map(known.__getitem__, u[1:])) for u in units]

    def _long(self, text: str) -> bytes:
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + STEP_CHARS)
            end = cut.start() if cut else len(text)
            parts += self._some([text[at:end]])
            at = end
        return b"".join(parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        out: list[bytes] = []
        some: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            if held + len(text) > STEP_CHARS and some:
                out += self._some(some)
                some, held = [], 0
            if len(text) > STEP_CHARS and self.by_units:
                out.append(self._long(text))
            else:
                some.append(text)
                held += len(text)
        return out + self._some(some) if some else out
