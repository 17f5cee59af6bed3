"""Words as arrays of 64-bit hashes, for operators that compare sequences of words in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
MAX_REMEMBERED = 1 << 20
ODD = np.random.default_rng(20_200_607).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """XXH64 of words, remembered for as many words as memory should hold."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with the texts as bytes (null: empty), each part of bounded bytes or a single text."""
    texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_bytes:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def hashed(texts: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each text begins (one more: the end)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    out = np.empty(int(ends[-1]), np.uint64)
    for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b] = np.fromiter(map(known.__getitem__, t), np.uint64, b - a)
    return out, ends


# Bytes of one step of hashing; a longer word is a step of its own.
PIECE_BYTES = 1 << 20
SPACE_BYTES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
LETTER = np.random.default_rng(20_211_103).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
RADIX = BASE | 3


class Powers:
    """Powers of an odd radix and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = [np.full(max(n, PIECE_BYTES) + 1, x, np.uint64) for x in (RADIX, pow(RADIX, -1, 1 << 64))]
            for powers in both:
                powers[0] = 1
                np.cumprod(powers, out=powers)
            self.up, self.down = both
        return self.up, self.down


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each text begins (one more: the end).

    No word becomes an object: a word's hash is a difference of running sums of
    its bytes, each times a power of its place, shifted back to place 0.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edges = np.flatnonzero(np.diff(~SPACE_BYTES[data], prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(stops, base + PIECE_BYTES, "right")))
        piece = data[base : stops[j - 1]]
        up, down = powers.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(LETTER[piece] * up[: len(piece)], out=sums[1:])
        a, b = starts[i:j] - base, stops[i:j] - base
        out[i:j] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * ODD[0])
        i = j
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return out, np.searchsorted(starts, begins)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def windows(words: np.ndarray, places: tuple[int, ...] | range, salt: int = 0) -> np.ndarray:
    """For each start, a hash of the words at these places after it; windows that pass the end are left out."""
    n = max(0, len(words) - places[-1])
    out = np.full(n, np.uint64(salt * BASE % (1 << 64)), np.uint64)
    for k, place in enumerate(places):
        out += words[place : place + n] * ODD[k % len(ODD)]
    return mixed(out)


def within(ends: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Whether a window of ``span`` words from each start stays within its text."""
    text = np.searchsorted(ends, starts, "right")
    return starts + span <= ends[np.minimum(text, len(ends) - 1)]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
