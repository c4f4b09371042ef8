"""Byte ranges that repeat: sparse anchors, local suffix arrays, longest previous factors.

Numpy helpers that run inside tasks; :mod:`suffix_dedup` holds the Spark job.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of the gram whose hash picks an anchor.
GRAM = 32
#: Words of the gram whose hash picks an anchor among words.
WORD_GRAM = 6
#: Bytes of a text that are hashed at once; pieces overlap by one window.
PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM`` bytes of ``data`` (uint8), by doubling."""
    size = len(data) - 7
    words = np.zeros(size, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i:i + size]
    h, width, step = words * _MIX[0], 8, 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _MIX[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def sparse_windows(text: bytes, length: int, words: int) -> np.ndarray:
    """For each window of ``length`` bytes: can it hold fewer than ``words`` whole words?

    Words at its two ends may be cut, so it holds two less than it has pieces
    of words. This depends on the window alone, not on what is around it.
    """
    data = np.frombuffer(text, np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begun = np.r_[0, np.cumsum(np.r_[inside[:1], inside[1:] & ~inside[:-1]])]
    size = max(0, len(text) - length + 1)
    pieces = begun[length:length + size] - begun[1:1 + size] + inside[:size]
    return pieces < words + 2


def anchors(text: bytes, length: int, wanted: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Cut the starts of all windows of ``length`` bytes, or of the ``wanted`` ones, into ranges by anchor.

    The anchor of a window is its gram with the smallest hash, the rightmost
    of equals, so equal windows have equal anchors at equal places. Gives
    ``(lo, hi, anchor, content)`` for each range of starts lo..hi that share
    an anchor; content hashes the bytes lo..hi+length-1 and lo's distance
    from the anchor.
    """
    found = []
    if wanted is not None and not wanted.any():
        return found
    span = length - GRAM + 1
    for base in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - base), base)
        h = gram_hashes(data)
        places = np.arange(len(h), dtype=np.uint64)
        picks = _LOW - (_window_min((h & ~_LOW) | (_LOW - places), span) & _LOW)
        change = picks[1:] != picks[:-1]
        if wanted is not None:
            own = wanted[base:base + len(picks)]
            change |= own[1:] != own[:-1]
        starts = np.flatnonzero(np.r_[True, change])
        ends = np.r_[starts[1:], len(picks)] - 1
        if wanted is not None:
            starts, ends = starts[own[starts]], ends[own[starts]]
        at = picks[starts].astype(np.int64)
        codes = h[at].view(np.int64)
        for lo, hi, p, code in zip(starts.tolist(), ends.tolist(), at.tolist(), codes.tolist()):
            piece = text[base + lo:base + hi + length]
            content = xxhash.xxh3_64_intdigest(piece, p - lo)
            found.append((base + lo, base + hi, code, content - (1 << 64) if content >> 63 else content))
    return found


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word; words are parted by ASCII white space."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where every word of :func:`word_hashes` starts and ends, in bytes."""
    data = np.frombuffer(text, np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(np.r_[0, inside.view(np.int8), 0]))
    return edges[::2], edges[1::2]


def word_anchors(words: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """:func:`anchors` of windows of ``length`` words, given the hashes of the words."""
    found = []
    for base in range(0, max(0, len(words) - length + 1), PIECE):
        data = words[base:base + PIECE + length - 1]
        size = len(data) - WORD_GRAM + 1
        h = np.zeros(size, np.uint64)
        for i in range(WORD_GRAM):
            h = (h ^ (h >> np.uint64(29))) * _MIX[0] + data[i:i + size]
        h ^= h >> np.uint64(32)
        h *= _MIX[3]
        h ^= h >> np.uint64(29)
        places = np.arange(size, dtype=np.uint64)
        picks = _LOW - (_window_min((h & ~_LOW) | (_LOW - places), length - WORD_GRAM + 1) & _LOW)
        starts = np.flatnonzero(np.r_[True, picks[1:] != picks[:-1]])
        ends = np.r_[starts[1:], len(picks)] - 1
        at = picks[starts].astype(np.int64)
        codes = h[at].view(np.int64)
        for lo, hi, p, code in zip(starts.tolist(), ends.tolist(), at.tolist(), codes.tolist()):
            content = xxhash.xxh3_64_intdigest(data[lo:hi + length].tobytes(), p - lo)
            found.append((base + lo, base + hi, code, content - (1 << 64) if content >> 63 else content))
    return found


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``starts`` by their first ``length`` bytes, or hashes of words.

    Prefix doubling: ranks of 8 bytes (or one word), then of twice as many and
    so on; the last step overlaps to end at ``length``. Returns the starts in suffix order (equal
    prefixes by place) and a flag for entries that equal the one before.
    """
    size = len(data)
    if data.dtype == np.uint64:
        words, width = data, 1
    else:
        words, width = np.zeros(size, np.uint64), 8
        padded = np.r_[data, np.zeros(8, np.uint8)]
        for i in range(8):
            words = (words << np.uint64(8)) | padded[i:i + size]
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while width < length:
        step = min(width, length - width)
        after = np.zeros(size, np.int64)
        after[:size - step] = rank[step:] + 1
        pair = rank * np.int64(size + 1) + after
        width += step
        if width >= length:
            pair = pair[starts]
            order = np.argsort(pair, kind="stable")
            return starts[order], np.r_[False, pair[order][1:] == pair[order][:-1]]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    raise ValueError("length must exceed 8 bytes or one word")


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: does its factor of ``length`` bytes occur earlier, and does it occur later?

    Among suffixes with equal prefixes the order is by place, so the previous
    smaller place of an entry is its left neighbour and the next one to the
    right is later. The longest previous factor reaches ``length`` exactly if
    that left neighbour shares the prefix.
    """
    order, same = suffix_order(data, starts, length)
    slot = np.searchsorted(starts, order)
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[slot] = same
    later[slot] = np.r_[same[1:], False]
    return earlier, later
