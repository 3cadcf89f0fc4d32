"""Cached encoding of text pieces: every distinct piece is encoded once, texts become gathers of piece ids."""

from __future__ import annotations

import numpy as np

#: Distinct pieces that one Python worker remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Pieces(dict):
    """Number of each piece; unknown pieces get the next number and wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending = []

    def __missing__(self, piece):
        n = len(self)
        self[piece] = n
        self.pending.append(piece)
        return n


class CachedEncoder:
    """Base of the encoders: ``split`` cuts a text into independent pieces, ``encode_pieces`` gives their ids and counts."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.pieces, self.offsets, self.flat, self.used = Pieces(), np.zeros(1, np.int64), np.zeros(1024, np.uint32), 0

    def split(self, text: str) -> list:
        raise NotImplementedError

    def encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _learn(self):
        ids, counts = self.encode_pieces(self.pieces.pending)
        self.pieces.pending = []
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offsets = np.concatenate((self.offsets, self.used + np.cumsum(counts)))
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has; null counts as empty."""
        if len(self.pieces) > REMEMBERED:
            self._reset()
        number = self.pieces.__getitem__
        numbers, n_pieces = [], []
        for text in texts:
            found = self.split(text) if text else []
            numbers.append(np.fromiter(map(number, found), np.int64, len(found)))
            n_pieces.append(len(found))
        if self.pieces.pending:
            self._learn()
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        lengths = self.offsets[flat + 1] - self.offsets[flat]
        ids = self.flat[ragged(self.offsets[flat], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(n_pieces)
        return ids, sums[ends] - sums[ends - n_pieces]
