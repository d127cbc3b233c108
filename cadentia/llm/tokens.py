"""Words of a batch of texts as arrays: where they stand, and 64-bit hashes, without a Python object for each.

A word's hash takes its bytes by eights, all words of a piece at once, each
eight put through a finaliser with the hash of those before; long words are
hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Words hashed at once, and bytes of a word from which on it is hashed by itself.
PIECE, LONG = 1 << 14, 32
#: The bytes of a word within an eight, by their number.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of words between blanks, and of words of letters, digits and everything beyond ASCII.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[9, 10, 11, 12, 13, 32]] = False
PLAIN = np.ones(256, bool)
PLAIN[:0x30] = PLAIN[0x3A:0x61] = PLAIN[0x7B:0x80] = False

def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and where each row's start, with the end; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; words end with their row."""
    gap = np.flatnonzero(np.frombuffer(data.tobytes().translate((~word).tobytes()), bool))
    begin = np.insert(gap + 1, np.searchsorted(gap, at[:-1]), at[:-1])
    end = np.insert(gap, np.searchsorted(gap, at[1:]), at[1:])
    full = begin < end
    return begin[full], end[full]


def eight(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The ``left`` bytes from byte ``at`` on, eight at most, as a number."""
    place, shift = at >> 3, ((at & 7) << 3).view(np.uint64)
    x = eights[place] >> shift
    x |= eights[place + 1] << np.uint64(1) << np.uint64(63) - shift
    x &= KEEP[np.minimum(left, 8)]
    return x


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each of the words; upper-case letters of ASCII count as lower-case."""
    text = data.tobytes().translate(LOWER)
    eights = np.frombuffer(text + bytes(16 - len(text) % 8), "<u8")
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), PIECE):
        s = start[i : i + PIECE]
        n = stop[i : i + PIECE] - s
        h = mix(n.view(np.uint64) * np.uint64(BASE) ^ eight(eights, s, n))
        word = np.arange(len(s))
        for k in range(8, min(int(n.max()), LONG), 8):
            word = word[n[word] > k]
            h[word] = mix(h[word] ^ eight(eights, s[word] + k, n[word] - k))
        for j in np.flatnonzero(n > LONG).tolist():
            h[j] = xxhash.xxh64_intdigest(text[s[j] : s[j] + n[j]])
        out[i : i + PIECE] = h
    return out


class Words:
    """hash, start and stop of every word of a column; the words of row i are first[i] to first[i + 1]."""

    def __init__(self, column: pa.Array, word: np.ndarray = BLANK_SPLIT):
        self.data, self.at = column_bytes(column)
        self.start, self.stop = bounds(self.data, self.at, word)
        self.hash = hashes(self.data, self.start, self.stop)
        self.first = np.searchsorted(self.start, self.at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def lines(self, row: np.ndarray) -> np.ndarray:
        """Number of each word's line within its row."""
        breaks = np.flatnonzero(self.data == 10)
        passed = np.cumsum(np.bincount(np.searchsorted(self.start, breaks), minlength=len(self.start) + 1))[: len(self.start)]
        return passed - np.searchsorted(breaks, self.at[:-1])[row]
