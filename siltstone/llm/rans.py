"""Static range asymmetric numeral systems over token ids.

A segment has one frequency table that all its blocks share. A block is coded on its own by LANES interleaved coders whose
16-bit words run into one stream in the order in which the decoder reads them; its checkpoint (first token, first word,
lane states) and checksum allow any block to be decoded alone, and all blocks of a segment side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Frequencies add up to 2**SCALE; states lie in 2**16 .. 2**32. Lanes and steps of a block.
SCALE, LANES, STEPS = 16, 64, 1024
TOTAL, LOW, BLOCK = 1 << SCALE, 1 << 16, LANES * STEPS


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Scaled frequency of every id up to the largest; each id that occurs has at least 1 and all add up to TOTAL."""
    counts = np.bincount(ids).astype(np.int64)
    if np.count_nonzero(counts) > TOTAL or len(counts) > TOTAL:
        raise ValueError(f"ids must be below {TOTAL}")
    freq = np.where(counts > 0, np.maximum(1, counts * TOTAL // max(1, counts.sum())), 0)
    over = int(freq.sum()) - TOTAL
    if over < 0:
        freq[np.argmax(freq)] -= over
    for i in np.argsort(-freq, kind="stable") if over > 0 else ():
        take = min(over, int(freq[i]) - 1)
        freq[i] -= take
        over -= take
        if not over:
            break
    return freq


def _encode(ids: np.ndarray, freq: np.ndarray, start: np.ndarray):
    """ids: blocks x steps x lanes. Streams and final states of all blocks, coded side by side from the last step to the first."""
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words, taken = np.zeros((steps, blocks, lanes), np.uint16), np.zeros((steps, blocks, lanes), bool)
    bits = np.uint64(16)
    for t in range(steps - 1, -1, -1):
        s = ids[:, t, :]
        f, c = freq[s], start[s]
        full = x >= (f << bits)
        words[t], taken[t] = x & np.uint64(0xFFFF), full
        x = np.where(full, x >> bits, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
    return [words[:, b, :][taken[:, b, :]] for b in range(blocks)], x.astype(np.uint32)


def _decode(streams: np.ndarray, first: np.ndarray, states: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    blocks, lanes = states.shape
    x, at = states.astype(np.uint64), first.astype(np.int64)
    out = np.zeros((blocks, steps, lanes), np.uint32)
    bits, low = np.uint64(16), np.uint64(LOW)
    for t in range(steps):
        slot = x & np.uint64(0xFFFF)
        s = symbol[slot]
        out[:, t, :] = s
        x = freq[s] * (x >> bits) + slot - start[s]
        need = x < low
        place = np.cumsum(need, axis=1)
        word = streams[np.minimum(at[:, None] + place - 1, len(streams) - 1)] if len(streams) else np.zeros_like(place, np.uint16)
        x = np.where(need, (x << bits) | word, x)
        at = at + place[:, -1]
    return out


def compress(ids: np.ndarray) -> dict:
    """Table, stream and block directory of one segment."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if not len(ids):
        return {"symbols": b"", "freqs": b"", "stream": b"", "blocks": []}
    freq = frequencies(ids)
    f64 = freq.astype(np.uint64)
    start = np.cumsum(f64) - f64
    n_full = len(ids) // BLOCK
    groups = [ids[: n_full * BLOCK].reshape(n_full, STEPS, LANES)] if n_full else []
    if rest := len(ids) - n_full * BLOCK:
        steps = -(-rest // LANES)
        tail = np.full(steps * LANES, int(np.argmax(freq)), np.uint32)
        tail[:rest] = ids[n_full * BLOCK :]
        groups.append(tail.reshape(1, steps, LANES))
    streams, blocks, at, token = [], [], 0, 0
    for group in groups:
        found, states = _encode(group, f64, start)
        for words, state in zip(found, states):
            n = min(BLOCK, len(ids) - token)
            blocks.append({"first_token": token, "n_tokens": n, "first_word": at, "states": state.astype("<u4").tobytes(), "crc32": zlib.crc32(ids[token : token + n].astype("<u4").tobytes())})
            streams.append(words)
            at += len(words)
            token += n
    used = np.flatnonzero(freq)
    return {"symbols": used.astype("<u2").tobytes(), "freqs": (freq[used] - 1).astype("<u2").tobytes(), "stream": np.concatenate(streams).astype("<u2").tobytes(), "blocks": blocks}


def decompress(symbols: bytes, freqs: bytes, stream: bytes, blocks: list[dict]) -> np.ndarray:
    """The ids of the given blocks of a segment (all, or any one), each checked against its checksum."""
    if not blocks:
        return np.zeros(0, np.uint32)
    used = np.frombuffer(symbols, "<u2").astype(np.int64)
    freq = np.zeros(int(used.max()) + 1, np.uint64)
    freq[used] = np.frombuffer(freqs, "<u2").astype(np.uint64) + np.uint64(1)
    start = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.uint32)
    words, parts = np.frombuffer(stream, "<u2").astype(np.uint64), []
    full = [b for b in blocks if b["n_tokens"] == BLOCK]
    for group, steps in [(full, STEPS)] * bool(full) + [([b], -(-b["n_tokens"] // LANES)) for b in blocks if b["n_tokens"] < BLOCK]:
        states = np.stack([np.frombuffer(b["states"], "<u4") for b in group])
        out = _decode(words, np.array([b["first_word"] for b in group]), states, steps, freq, start, symbol)
        for b, ids in zip(group, out):
            ids = ids.ravel()[: b["n_tokens"]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != b["crc32"]:
                raise ValueError(f"block at token {b['first_token']} does not match its checksum")
            parts.append((b["first_token"], ids))
    return np.concatenate([ids for _, ids in sorted(parts, key=lambda p: p[0])])
