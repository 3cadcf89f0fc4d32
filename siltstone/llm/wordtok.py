"""Encoding with a public word-level tokenizer file through the tokenizers library.

The file's pre-tokenizer never joins characters across ASCII white space, and its normalizer works on them apart, so the
ids of a text are those of its white-space words in order; every distinct word goes through the library once.

Most time goes into normalizing and cutting words that are plain already. So words of Latin-1 letters, alone or before a
run of ordinary marks, are written as the file's own steps would leave them, and the library merges them behind a
pre-tokenizer that only cuts at spaces. This is done for files with exactly these steps; their tokens tell where a piece ends. A word's letters and its marks are
remembered apart.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from siltstone.llm.pieces import REMEMBERED, CachedEncoder, ragged

#: A word that stands between others in one call of the library; words that hold it are encoded alone.
MARK, TOGETHER = "|", 512
#: The steps of a file whose plain words can be written as they leave them, and the plain words: letters, then marks that are one piece.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PLAIN, END = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)#$%&*]*)").fullmatch, "</w>"
#: Bytes as the characters of byte-level tokenizers: printable ones stand for themselves, all others follow from 256 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}


class PlainEncoder(CachedEncoder):
    """Pieces as a file's own steps leave them, merged by the library's model behind a cut at spaces."""

    def __init__(self, library, vocab: dict[str, int]):
        super().__init__()
        self.library, self.ends = library, np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True

    @staticmethod
    def of(path: str) -> PlainEncoder | None:
        """None for files of other steps."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told.get("model", {})
        options = [model.get(k) for k in ("type", "end_of_word_suffix")] + [model.get(k) or None for k in ("dropout", "continuing_subword_prefix", "ignore_merges")]
        if {k: told.get(k) for k in STEPS} != STEPS or options != ["BPE", END, None, None, None] or any(PLAIN(t["content"]) for t in told.get("added_tokens", ())):
            return None
        library = Tokenizer.from_file(path)
        library.normalizer, library.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        return PlainEncoder(library, model["vocab"])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(pieces[k : k + TOGETHER]) for k in range(0, len(pieces), TOGETHER)]
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[flat])
        if len(last) == len(pieces) and last[-1] == len(flat) - 1:
            return flat, np.diff(last, prepend=-1)
        alone = [np.array(self.library.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces]
        return np.concatenate(alone), np.array([len(x) for x in alone])

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each piece has."""
        if len(self.pieces) > REMEMBERED:
            self._reset()
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        if self.pieces.pending:
            self._learn()
        lengths = self.offsets[numbers + 1] - self.offsets[numbers]
        return self.flat[ragged(self.offsets[numbers], lengths)], lengths


class WordEncoder(CachedEncoder):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.plain = PlainEncoder.of(path)

    def split(self, text: str) -> list:
        raw = text.encode()
        # the normalizer lower-cases too; doing it before is the same unless an ASCII letter is composed with a mark (U+0300 to U+037F)
        return (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()

    def encode_plain(self, found: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of plain words."""
        flat, tails = [], np.zeros(len(found), np.int64)
        for i, match in enumerate(found):
            word, tail = match.groups()
            word = word.lower()
            flat.append(word if word.isascii() else word.encode().decode("latin-1").translate(LEVEL))
            if tail:
                flat.append(tail)
                tails[i] = 1
        ids, lengths = self.plain.each(flat)
        return ids, np.add.reduceat(lengths, np.arange(len(found)) + np.cumsum(tails) - tails)

    def encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode() for p in pieces]
        found = list(map(PLAIN, words)) if self.plain else []
        if not any(found):
            return self.encode_long(words)
        got = self.encode_plain([m for m in found if m])
        if all(found):
            return got
        long = self.encode_long([w for w, m in zip(words, found) if not m])
        is_plain = np.array([m is not None for m in found])
        order = np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain)))
        back = np.argsort(order, kind="stable")
        flat, counts = (np.concatenate(x) for x in zip(got, long))
        return flat[ragged((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def encode_long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words by all steps of the file."""
        alone = np.array([self.mark is None or MARK in w for w in words], bool)
        order, ids, counts = [np.flatnonzero(~alone), np.flatnonzero(alone)], [], []
        some = [words[i] for i in order[0]]
        texts = [f" {MARK} ".join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
        for encoding in self.library.encode_batch_fast(texts, add_special_tokens=False):
            found = np.array(encoding.ids, np.uint32)
            marks = np.flatnonzero(found == self.mark)
            counts.append(np.diff(marks, prepend=-1, append=len(found)) - 1)
            ids.append(np.delete(found, marks))
        for i in order[1]:
            ids.append(np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(ids[-1])]))
        flat, counts = np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])
        if not len(order[1]):
            return flat, counts
        back = np.argsort(np.concatenate(order), kind="stable")
        return flat[ragged((np.cumsum(counts) - counts)[back], counts[back])], counts[back]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind the ids of every text."""
    if not len(counts):
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1
