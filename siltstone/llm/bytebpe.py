"""Byte-level BPE as padded numpy matrices.

Distinct pieces of the split pattern are put into buckets by length, one row of a matrix for each piece. In every round each
row merges its leftmost pair of least rank: pairs are looked up in an open-addressed hash table of all token pairs, the rest
of the row moves left by one, and rows without a pair left are written out and dropped from the matrix. A piece too long to
share a matrix is a row of its own. There a round merges all pairs of the least rank from left to right, up to one whose new
token forms a pair of lower rank, which gives the same ids; places are found by rank and linked to their neighbours, so a
round costs what it merges, and the row is compacted at the end.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, types as T

from siltstone.llm.common import map_texts
from siltstone.llm.pieces import CachedEncoder, ragged

#: Widest row of a matrix with other rows; a longer piece is a matrix of its own. Rows that are merged at once.
WIDEST, ROWS = 512, 1 << 16
NONE = np.int32(np.iinfo(np.int32).max)
EMPTY, FACTOR = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
_CODERS: dict[tuple[str, str], "ByteBpe"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Rank of the token that two neighbours form, by hash of the pair; linear probing in numpy."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values, slot = np.array(list(pairs.values()), np.int32), self._slot(keys)
        while len(keys):  # of those that want one slot the first gets it, the others try the next
            free = self.keys[slot] == EMPTY
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != EMPTY)]
        return out


class ByteBpe(CachedEncoder):
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.find_pieces, self.ranks = regex.compile(pattern).findall, ranks
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.token_lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.token_lengths[rank] = len(token)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.zeros(int(self.token_lengths.sum()), np.uint8)
        for token, rank in ranks.items():
            self.token_bytes[self.token_starts[rank] :][: len(token)] = np.frombuffer(token, np.uint8)

    def split(self, text: str) -> list:
        return self.find_pieces(text)

    def merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: padded matrix of byte tokens. Merged ids of all rows in order, and how many each row has."""
        n, width = rows.shape
        done, counts = np.zeros((n, width), np.int32), lengths.copy()
        live, cols = np.arange(n), np.arange(width)
        best = np.full((n, width), NONE, np.int32)
        inside = cols[None, :-1] < (lengths - 1)[:, None]
        best[:, :-1][inside] = self.table.find(rows[:, :-1][inside], rows[:, 1:][inside])
        while len(live):
            at = best.argmin(axis=1)  # the first of equal ranks is the leftmost
            rank = best[np.arange(len(live)), at]
            end = rank == NONE
            if end.any():
                done[live[end]], counts[live[end]] = rows[end], lengths[end]
                rows, lengths, best, live, at, rank = rows[~end], lengths[~end], best[~end], live[~end], at[~end], rank[~end]
                if not len(live):
                    break
            each = np.arange(len(live))
            move = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            rows, best = np.take_along_axis(rows, move, 1), np.take_along_axis(best, move, 1)
            rows[each, at] = rank
            lengths = lengths - 1
            best[each, np.maximum(lengths - 1, 0)] = NONE
            best[each, at] = NONE
            right = at < lengths - 1
            best[each[right], at[right]] = self.table.find(rows[each[right], at[right]], rows[each[right], at[right] + 1])
            left = at > 0
            best[each[left], at[left] - 1] = self.table.find(rows[each[left], at[left] - 1], rows[each[left], at[left]])
        return done[cols[None, :] < counts[:, None]], counts

    def merge_alone(self, piece: bytes) -> np.ndarray:
        """A row of its own: in a round all pairs of least rank merge, leftmost first."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Remember the pairs that start at these places, by rank."""
            at = at[after[at] >= 0]
            rank = self.table.find(ids[at], ids[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[first].tolist(), np.split(at, first[1:])):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[(ids[at] >= 0) & (after[at] >= 0)]
            at = at[self.table.find(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            # of pairs that overlap every other one merges; the others too are kept, as a pair of lower rank may come between
            all_at = at
            chain = np.append(True, at[1:] != after[at[:-1]])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            # what a merge meets on its left, where the one before may have just merged, and on its right
            left, gone = before[at], after[at]
            right = np.where(gone >= 0, after[gone], -1)
            beside = np.append(False, left[1:] == gone[:-1])
            low = np.where(left >= 0, self.table.find(np.where(beside, rank, ids[left]), np.full(len(at), rank)), NONE)
            low = np.minimum(low, np.where(right >= 0, self.table.find(np.full(len(at), rank), ids[right]), NONE))
            lower = np.flatnonzero(low < rank)
            if len(lower) and lower[0] + 1 < len(at):
                k = lower[0] + 1
                places[rank] = [all_at[all_at > at[k - 1]]]
                heapq.heappush(ranks, rank)
                at, gone, right = at[:k], gone[:k], right[:k]
            ids[at], ids[gone], after[at] = rank, -1, right
            before[right[right >= 0]] = at[right >= 0]
            left = before[at]
            note(np.unique(np.concatenate((left[left >= 0], at))))
        return ids[ids >= 0]

    def encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw], np.int64)
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int32)  # a piece that is a token stays one
        counts, found = np.ones(len(raw), np.int64), []
        at = np.flatnonzero(whole >= 0)
        found.append((at, whole[at]))
        width = 2
        while width <= WIDEST:
            bucket = np.flatnonzero((whole < 0) & (lengths <= width) & (lengths > width // 2))
            for k in range(0, len(bucket), max(1, ROWS * 8 // width)):
                some = bucket[k : k + max(1, ROWS * 8 // width)]
                flat = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
                rows = np.zeros((len(some), width), np.int32)
                rows[np.arange(width)[None, :] < lengths[some][:, None]] = self.of_byte[flat]
                ids, n = self.merge_rows(rows, lengths[some])
                counts[some] = n
                found.append((some, ids))
            width *= 2
        for i in np.flatnonzero((whole < 0) & (lengths > WIDEST)):
            ids = self.merge_alone(raw[i])
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        out, starts = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for at, ids in found:
            out[ragged(starts[at], counts[at])] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[ragged(self.token_starts[ids], self.token_lengths[ids])].tobytes()


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each file, pattern and Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Add ``ids`` of each whole text, as the tokens of its pieces in order.

    Null and empty texts have none; texts and pieces of any length count whole; repeated rows have equal ids; of pairs of
    equal rank the leftmost merges first; an empty table gives an empty result. A kept column named ``ids`` gives way.
    """

    def make():
        bpe = coder(path, pattern)

        def call(texts):
            ids, counts = bpe.encode(texts)
            return {"ids": [p.astype(np.int32) for p in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []}

        return call

    return map_texts(docs, keep, text_col, make, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text; add the number of ids and the SHA-256 of the ids and of the decoded bytes.

    Null and empty texts have no ids and the digest of no bytes; all else as in ``encode``.
    """

    def make():
        bpe = coder(path, pattern)

        def call(texts):
            ids, counts = bpe.encode(texts)
            parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            return {
                "n_tokens": counts,
                "ids_sha256": [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts],
                "decoded_sha256": [hashlib.sha256(bpe.decode(p)).hexdigest() for p in parts],
            }

        return call

    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_texts(docs, keep, text_col, make, added)


def op8(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
