"""Word shingles of a text as 64-bit numbers."""

from __future__ import annotations

import re

import numpy as np

_random = np.random.default_rng(20240229).integers(1, 1 << 63, 257, dtype=np.uint64)
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
LETTER = np.where(SPACES, np.uint64(0), _random[:256])  # a number for every byte, none for white space
FACTOR = _random[256] | np.uint64(1)
BITS = 12
NEAR = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << BITS) - 1, FACTOR)]), dtype=np.uint64)  # powers of the factor
BLOCK = 1 << 20  # bytes hashed at once
_space = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _hash_block(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    space = SPACES[b]
    begins = ~space
    begins[1:] &= space[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64)
    inside = np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    weight = NEAR[inside & ((1 << BITS) - 1)]
    if inside[-1] >> BITS or len(b) >> BITS and (inside >> BITS).any():  # a word longer than the table
        far = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b) >> BITS, (NEAR[-1:] * FACTOR)[0])]), dtype=np.uint64)
        weight = weight * far[inside >> BITS]
    return mix(np.add.reduceat(LETTER[b[start[0]:]] * weight, start - start[0]))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word; words stand between the ASCII white space characters.

    A polynomial over random numbers for the bytes, all words at once; long texts go block by block, cut between words.
    """
    out, low = [], 0
    while low < len(text):
        high = len(text)
        if low + BLOCK < high:
            gap = _space.search(text, low + BLOCK)
            high = gap.start() if gap else high
        out.append(_hash_block(text[low:high]))
        low = high
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits, so that the order of the numbers is unrelated to the words."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of n words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    return mix(h)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of a text whose A-Z count as a-z; a shorter text is one shingle."""
    words = word_hashes(text.lower())  # bytes: only ASCII letters change
    if not len(words):
        return words
    out = np.sort(runs(words, min(n, len(words))))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
