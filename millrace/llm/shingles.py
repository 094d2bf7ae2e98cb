"""Sets of word shingles as hashes, for many texts at once.

Words are runs of characters other than ASCII white space, and A-Z count as a-z. A word's hash is a
polynomial over its bytes modulo 2^64, so that all words of a block of texts take a few passes of numpy;
a shingle's hash is folded from those of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: bytes of a block; the longest word that the polynomial takes
BLOCK = 1 << 20
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
BLANK = re.compile(rb"[ \t-\r]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte, capitals as small letters; whether it is part of a word)."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * M1)
    codes[65:91] = codes[97:123]
    part = np.ones(256, bool)
    part[[9, 10, 11, 12, 13, 32]] = False
    return codes, part


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    base = int(M1)
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, their starts)."""
    codes, part = tables()
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(part[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(1 << max(21, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    out = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * M2)
    for i in np.flatnonzero(end - start > BLOCK):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].lower())
    return out, start


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end before white space; a giant word is a part of its own."""
    at = 0
    while len(raw) - at > BLOCK and (cut := BLANK.search(raw, at + BLOCK)):
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    found, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        raw = b"\n".join([x for _, x in held])
        ends = np.cumsum([len(x) + 1 for _, x in held])
        words, start = _block(raw)
        found.append(words)
        np.add.at(counts, [i for i, _ in held], np.diff(np.searchsorted(start, ends), prepend=0))
        held.clear()

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        for x in _parts(raw) if len(raw) > BLOCK else [raw]:
            held.append((i, x))
            size += len(x)
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts


def shingle_sets(texts: list[str], shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each text's sorted distinct shingle hashes; all word hashes; number of words of each text).

    Fewer words than a shingle, or none, make one shingle.
    """
    words, counts = word_hashes(texts)
    # each text's words (or one empty place), then shingle - 1 empty places, so that no shingle crosses texts
    room = np.maximum(counts, 1) + shingle - 1
    first = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()) + shingle, np.uint64)
    padded[np.arange(len(words)) + np.repeat(first - (np.cumsum(counts) - counts), counts)] = words
    n = len(padded) - shingle
    grams = padded[:n].copy()
    for j in range(1, shingle):
        grams = mixed(grams * M1 + padded[j : j + n])
    many = np.maximum(counts - shingle + 1, 1)
    return [np.unique(grams[a : a + k]) for a, k in zip(first.tolist(), many.tolist(), strict=True)], words, counts


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0
