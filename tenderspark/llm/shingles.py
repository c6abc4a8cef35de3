"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than space and U+0009-U+000D after A-Z are lower-cased. A text's set holds its distinct
shingles of `width` words; a shorter text is one shingle as a whole; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))  # a random value for each byte
_BYTES[65:91] = _BYTES[97:123]  # lower case
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, word count of each text)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _power_tables(len(joined) + 1)
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[joined] * up[: len(joined)], out=total[1:])
    space = np.concatenate([[True], _SPACE[joined]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    begins, ends = edge[::2], edge[1::2]
    hashes = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(begins, text_ends)
    return hashes, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; their count for each text)."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    if not len(words):
        return words, counts
    rolled = words.copy()
    length = np.ones(len(words), np.int64)
    left = np.repeat(first + counts, counts) - np.arange(len(words))  # words from here to the text's end
    for k in range(1, width):
        more = np.flatnonzero(left > k)
        rolled[more] = mix(rolled[more] * _U64(0xD6E8FEB86659FD93) + words[more + k])
        length[more] += 1
    whole = np.arange(len(words)) == np.repeat(first, counts)  # a short text's only shingle
    keep = (length == width) | (whole & np.repeat(counts < width, counts))
    rolled, owner = rolled[keep], owner[keep]
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    return rolled[new], np.bincount(owner[new], minlength=len(texts))
