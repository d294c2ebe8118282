"""Encoding whole texts with the tokenizers library, each distinct word once.

Both pre-tokenizers used here never join text across a space in a way that depends on more
than the piece between spaces, so a text is cut at its spaces and each distinct piece is looked
up. A new piece that is a plain word with marks behind it is cut where the pre-tokenizer cuts
it, and the parts not met before are encoded many in one call; any other piece goes through the
library by itself. Texts where a cut at spaces would not hold (a space inside or at the end of
longer white space, or the name of a special token) go to the library whole. Numpy then gathers
the texts' ids from the table of pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

_SPACE_BEFORE = re.compile(r" \s")
_INNER_SPACE = re.compile(r"\s \s|\s \Z")
# Letters, then marks that are neither letters, digits, white space nor the sign of a contraction.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")
# Stands before the first piece of a text, which has no space in front; not a character of texts cut here.
_FIRST = "\x00"
_MADE: dict[tuple[str, bool], Encoder] = {}


class _Numbers(dict):
    """String to its number; one not met before gets the next number and is noted in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class _Table:
    """Lists of ids by number, in one growing array, and how often each was used since the table was last thinned."""

    def __init__(self):
        self.uses = np.zeros(1 << 14, np.int32)
        self.flat, self.starts, self.lengths, self.n, self.used = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.starts) < self.n + len(lengths):
            self.starts, self.lengths = np.concatenate([self.starts, np.empty_like(self.starts)]), np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.n, self.used = self.n + len(lengths), self.used + len(ids)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered lists one after another, and the end of each."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        places = np.repeat(self.starts[at] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self.flat[places], ends

    def count(self, at: np.ndarray) -> None:
        while len(self.uses) < self.n:
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.uses[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)


def thinned(numbers: _Numbers, table: _Table, most: int) -> tuple[_Numbers, _Table]:
    """What was used again since it came or since the last time; nothing, if that is more than ``most``."""
    some, lists = _Numbers(), _Table()
    again = np.flatnonzero(table.uses[: table.n] > 1)
    if len(again) <= most:
        names = list(numbers)
        some.update((names[k], n) for n, k in enumerate(again.tolist()))
        lists.add(table.take(again)[0], table.lengths[again])
        lists.count(np.arange(len(again)))
    return some, lists


class Encoder:
    """``spaced``: the vocabulary keeps white space, so all pieces but the first carry the space before them."""

    # Pieces and words kept at most; beyond that a table keeps what was used again, so that a worker's memory is
    # bounded. Words cost most to learn and recur in new pieces, so more of them are kept: about 200 bytes each.
    PIECES, WORDS = 240_000, 400_000
    # Words in one call of the library: long calls take it longer per word.
    CALL = 512

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.spaced = spaced
        # A pre-token by itself that no word holds: it parts the words of one call, and its id the ids.
        self.between = "\n" if spaced else "1"
        (self.mark,) = self.tok.encode(self.between, add_special_tokens=False).ids
        self.pieces, self.piece_ids = _Numbers(), _Table()
        self.words, self.word_ids = _Numbers(), _Table()

    def thin(self) -> None:
        if len(self.pieces) > self.PIECES:
            self.pieces, self.piece_ids = thinned(self.pieces, self.piece_ids, self.PIECES * 2 // 3)
        if len(self.words) > self.WORDS:
            self.words, self.word_ids = thinned(self.words, self.word_ids, self.WORDS * 2 // 3)

    def _plain(self, piece: str) -> list[int] | None:
        """Numbers of a piece's pre-tokens, if they are plain words and marks."""
        lead = ""
        if self.spaced:
            lead, piece = ("", piece[1:]) if piece.startswith(_FIRST) else (" ", piece)
        else:
            piece = (piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")).lower()
        number, out = self.words, []
        for line in piece.split("\n") if "\n" in piece else (piece,):
            plain = _PLAIN.fullmatch(line)
            if not plain:
                return None
            letters, marks = plain.groups()
            if not letters.isalpha():
                return None
            if out and self.spaced:
                out.append(number["\n"])
            out.append(number[lead + letters])
            lead = ""
            if marks:
                out.append(number[marks])
        return out

    def _learn_words(self) -> None:
        fresh = self.words.fresh
        for at in range(0, len(fresh), self.CALL):
            some = fresh[at : at + self.CALL]
            if "\n" in some:  # the mark itself, in texts with line ends
                some = [w if w != "\n" else "" for w in some]
            ids = np.array(self.tok.encode_batch_fast([self.between.join(some) + self.between], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark) - np.arange(len(some))
            lengths, ids = np.diff(ends, prepend=0), ids[ids != self.mark]
            if "" in some:
                k = some.index("")
                ids, lengths[k] = np.insert(ids, int(lengths[:k].sum()), self.mark), 1
            self.word_ids.add(ids, lengths)
        fresh.clear()

    def _learn(self) -> None:
        """Ids of the fresh pieces: from their words, those not met before encoded many at a time."""
        words: list[int] = []
        counts, others = [], []
        match, number, spaced, lead = _PLAIN.fullmatch, self.words, self.spaced, " " if self.spaced else ""
        for k, piece in enumerate(self.pieces.fresh):
            # Most pieces are one word with or without marks: the case of ``_plain`` that needs no list.
            if spaced or piece.isascii():
                plain = match(piece if spaced else piece.lower())
                if plain:
                    letters, marks = plain.groups()
                    if letters.isalpha():
                        words.append(number[lead + letters])
                        if marks:
                            words.append(number[marks])
                            counts.append(2)
                        else:
                            counts.append(1)
                        continue
            got = self._plain(piece)
            if got is None:
                others.append(k)
                counts.append(0)
            else:
                words += got
                counts.append(len(got))
        if self.words.fresh:
            self._learn_words()
        numbers = np.array(words, np.int64)
        self.word_ids.count(numbers)
        ids, ends = self.word_ids.take(numbers)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(cuts)
        if others:
            whole = [self.pieces.fresh[k] for k in others]
            if self.spaced:
                whole = [p[1:] if p.startswith(_FIRST) else " " + p for p in whole]
            got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)]
            more = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.insert(ids, np.repeat(cuts[others], more), np.concatenate(got))
            lengths[others] = more
        self.piece_ids.add(ids, lengths)
        self.pieces.fresh.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
        self.thin()
        whole, parts = [], []
        for i, t in enumerate(texts):
            if "<|" in t or self.spaced and (_FIRST in t or (t.endswith(" ") or _SPACE_BEFORE.search(t)) and _INNER_SPACE.search(t)):
                whole.append(i)
                parts.append([])
                continue
            # Where white space has no ids, a line end parts pieces like a space, and the same words come in fewer pieces.
            parts.append(some := t.split(" ") if self.spaced else t.replace("\n", " ").split(" "))
            if self.spaced:
                some[0] = _FIRST + some[0]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self.pieces.fresh:
            self._learn()
        self.piece_ids.count(at)
        ids, ends = self.piece_ids.take(at)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in whole:
            out[i] = np.asarray(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each vocabulary and worker process, kept between tasks."""
    key = (path, spaced)
    if key not in _MADE:
        _MADE[key] = Encoder(path, spaced)
    return _MADE[key]
