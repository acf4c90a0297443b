"""Byte-level BPE encoding of whole texts with the tokenizers library, through a cache of text units.

A unit is a run of white space and the run of other characters after it.  The tokenizer's pre-tokenizer
never joins characters across the end of such a run, so the ids of a text are those of its units in order;
each distinct unit goes through the library's model once per worker.  A text that holds the content of an added
token which the library looks for goes to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: Bytes of distinct units and their ids that a worker keeps, counted as ``UNIT_BYTES`` and the unit's own; longer units than ``LONG`` are not kept.
CACHE_BYTES, UNIT_BYTES, LONG = 144 << 20, 130, 64
#: White space other than the blank and the line feed.
_OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters up to U+00FF, as far as their class is beyond doubt, and signs that the split pattern leaves alone.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space for Python alone
_UNIT = re.compile(r"\s*\S+|\s+")
#: The split pattern of the byte-level pre-tokenizer.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Units(dict):
    """Unit -> index; a new unit gets the next index and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []
        self.given = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = index = self.given
        self.given += 1
        self.waiting.append(unit)
        return index


class Encoder:
    def __init__(self, path: str, added_tokens: bool = False):
        """``added_tokens``: the content of a special token in a text is that token, the library's default; else it is plain text."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        found = self.tokenizer.get_added_tokens_decoder().values()
        self._whole = (*_ODD, *[t.content for t in found if added_tokens or not t.special])
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self._model, self._letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        self._blank, self._signs = self._letters[32], {}
        self._clear()

    def _clear(self) -> None:
        self._units, self._done, self._held = _Units(), 0, 0
        self._starts, self._ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self._uses = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Keeps the units that were used again, at most half of the cache: the commonest first."""
        words, at = list(self._units), np.fromiter(self._units.values(), np.int64, len(self._units))
        uses, sizes = self._uses[at], self._starts[at + 1] - self._starts[at]
        bytes_ = np.fromiter(map(len, words), np.int64, len(words)) + 4 * sizes + UNIT_BYTES
        order = np.argsort(-uses, kind="stable")
        order = np.sort(order[(uses[order] > 1) & (np.cumsum(bytes_[order]) <= CACHE_BYTES // 2)])
        first, size = self._starts[at[order]], sizes[order]
        ends = np.cumsum(size)
        ids = self._ids[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._clear()
        self._units.update((words[k], n) for n, k in enumerate(order.tolist()))
        self._units.given = self._done = len(order)
        self._held = int(bytes_[order].sum())
        self._starts, self._ids = np.concatenate([np.zeros(1, np.int64), ends]), ids
        self._uses = uses[order] // 2  # older uses count half

    def _piece(self, piece: str) -> list[int]:
        if piece[0] == " " and (at := self._units.get(piece[1:], self._done)) < self._done:
            return self._ids[self._starts[at]:self._starts[at + 1]].tolist()  # a unit that is known already
        letters = piece if piece.isascii() else piece.encode().decode("latin-1")
        return [t.id for t in self._model.tokenize(letters.translate(self._letters))]

    def _unit(self, unit: str) -> list[int]:
        if unit[1:].isascii() and unit[1:].isalpha() and (unit[0] == " " or "A" <= unit[0] <= "z" and unit[0].isalpha()):
            return [t.id for t in self._model.tokenize(self._blank + unit[1:] if unit[0] == " " else unit)]
        if m := _WORD.fullmatch(unit):  # Latin letters, then one other sign or none
            if m[2] not in self._signs:
                self._signs[m[2]] = self._piece(m[2]) if m[2] else []
            return self._piece(m[1]) + self._signs[m[2]]
        if unit and max(unit) > "ɏ":  # beyond Latin letters the library splits
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        return [i for piece in _SPLIT.findall(unit) for i in self._piece(piece)]

    def _pieces(self, text: str) -> list[str]:
        """Keys of the units of a text: a unit with one leading space goes without it, others after a CR, or from their line feed."""
        if not any(c in text for c in _OTHER_SPACE):
            pieces = text.replace("\n", " \n").split(" ")
            if "" not in pieces and "\n" not in pieces:
                pieces[0] = "\r" + pieces[0]
                return pieces
        return [u[1:] if u[0] == " " and not u[1:2].isspace() and len(u) > 1 else "\r" + u for u in _UNIT.findall(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        if self._held > CACHE_BYTES:
            self._shrink()
        units, waiting = self._units, self._units.waiting
        index, whole = [], {}
        for k, text in enumerate(texts):
            if any(c in text for c in self._whole):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                index.append(np.zeros(0, np.int64))
            elif text:
                pieces = self._pieces(text)
                index.append(np.fromiter(map(units.__getitem__, pieces), np.int64, len(pieces)))
            else:
                index.append(np.zeros(0, np.int64))
        if waiting:
            new = [self._unit(u[1:] if u[0] == "\r" else u if u[0] == "\n" else " " + u) for u in waiting]
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum([len(x) for x in new])])
            self._ids = np.concatenate([self._ids, np.array([i for x in new for i in x], np.uint32)])
            self._held += sum(map(len, waiting)) + 4 * sum(map(len, new)) + UNIT_BYTES * len(waiting)
        at = np.concatenate(index) if index else np.zeros(0, np.int64)
        uses = np.bincount(at, minlength=units.given)
        uses[:len(self._uses)] += self._uses
        self._uses = uses.astype(np.int32)
        first, size = self._starts[at], self._starts[at + 1] - self._starts[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._ids[np.repeat(first - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)]
        for unit in waiting:
            if len(unit) > LONG:  # long units are not worth keeping
                del units[unit]
        waiting.clear()
        self._done = units.given
        return [whole[k] if k in whole else flat[bounds[k]:bounds[k + 1]] for k in range(len(texts))]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One encoder per worker, vocabulary file and setting."""
    key = path, added_tokens
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, added_tokens)
    return _ENCODERS[key]
