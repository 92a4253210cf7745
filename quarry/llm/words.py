"""Words of whole texts and their 64-bit hashes, vectorised over slices of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  UTF-8 never uses those bytes inside a
character, so the byte view and the character view agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A row of byte values for each seed: hashes of different seeds have nothing in common.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[:, _LOWER]
_STEP = _U(0x9E3779B97F4A7C15)
#: Bytes of text that are expanded to arrays at a time.
SLICE_BYTES = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words of some consecutive texts: byte spans, hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than there are texts


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 0) -> Words:
    """Words and their hashes: a sum over bytes, each scrambled together with its place in the word.

    No product of powers stands for the place, so that words built from two strings in a regular
    order do not cancel out.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    gap = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    word = ~gap
    start = np.flatnonzero(word & (before | edge[:-1]))
    stop = np.flatnonzero(word & (after | edge[1:])) + 1
    if not len(start):
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    lens = stop - start
    cuts = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], lens)
    value = (_BYTE_LOWER if lower else _BYTE)[seed][data[word]] + at.astype(np.uint64) * _STEP
    value = (value ^ (value >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    value ^= value >> _U(32)
    h = mix(np.add.reduceat(value, cuts[:-1]) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return Words(data, start, stop, h, np.searchsorted(start, offsets))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes: runs of powers of two are joined, each join is scrambled."""
    count = len(h) - width + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    power, out, at = h, None, 0
    for bit in range(width.bit_length()):
        size = 1 << bit
        if width & size:
            piece = power[at : at + count]
            out = piece if out is None else mix(out * _STEP + piece)
            at += size
        if width >> bit > 1:
            power = mix(power[:-size] * _STEP + power[size:])
    return mix(out + _U(width * 0xA0761D6478BD642F & (1 << 64) - 1))


def joined(words: Words) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and where each begins there (one more: the end and a space)."""
    lens = words.stop - words.start
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(begin[:-1], lens) + inner] = words.data[np.repeat(words.start, lens) + inner]
    return out.tobytes(), begin


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words, as int64.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    full = window_hashes(words.hash, width).view(np.int64)
    for a, m in zip(words.first.tolist(), np.diff(words.first).tolist()):
        if m >= width:
            yield np.unique(full[a : a + m - width + 1])
        elif m:
            yield window_hashes(words.hash[a : a + m], m).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
