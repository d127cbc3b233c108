"""The join behind prefix-filtered set similarity.

Sets whose tokens follow one global order, rarest first, and that are similar
enough share a token among the first few of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, longs, ranges


#: Words of parities of a set, and sets whose parities are counted at once.
WORDS, SETS = 4, 1024


def overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Common tokens that sizes n and m need: the least i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def by_line(line: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order by line, rarity of the token, token.

    One sort of packed keys (line, rarity in 4096 grades, 32 bits of the hash)
    does it; where different tokens have equal keys, which is rare, all bits are compared.
    """
    grade = (np.log2(count.astype(np.float64) + 1) * 128).astype(np.uint64)
    if len(line) and line[-1] < 1 << 20:
        key = line.astype(np.uint64) << np.uint64(44) | grade << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key)
        key = key[order]
        twins = np.flatnonzero(key[1:] == key[:-1])
        if (h[order[twins]] == h[order[twins + 1]]).all():
            return order
    return np.lexsort((h, h & np.uint64(0xFFFFFFFF), grade, line))


def prefix(h: np.ndarray, n: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest tokens of each set, which lie one after another in ``h``: the token, its set, and size << 32 | place."""
    owner = np.repeat(np.arange(len(n)), n)
    h = h[by_line(owner, h, counts[(h % np.uint64(len(counts))).astype(np.int64)])]
    start = np.cumsum(n) - n
    length = n - -(-percent * n // 100) + 1
    at = ranges(start, length)
    own = np.repeat(np.arange(len(n)), length)
    return h[at].view(np.int64), own, n[own] << 32 | (at - start[own])


def parities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """WORDS words of parities for each of the sets that lie one after another in ``h``: two sets differ in as many tokens, at least, as their parities in bits."""
    bit = (h >> np.uint64(40) & np.uint64(64 * WORDS - 1)).astype(np.uint8 if WORDS <= 4 else np.uint16)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((len(n), WORDS), np.int64)
    for i in range(0, len(n), SETS):  # a table of counts for so many sets at once
        j = min(i + SETS, len(n))
        own = np.repeat(np.arange(j - i), n[i:j])
        odd = (np.bincount(own * (64 * WORDS) + bit[ends[i] : ends[j]], minlength=(j - i) * 64 * WORDS) & 1).astype(np.uint8)
        out[i:j] = np.packbits(odd.reshape(j - i, 64 * WORDS), axis=1, bitorder="little").view(np.int64)
    return out


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids of different labels whose sets share a prefix token and pass the bounds of length, position and parities.

    entries: (token, id, label, size_at, p0, p1, ...).  Where sets resemble each
    other, but not enough, as letters of one form do, the parities let few of
    their pairs pass.
    """
    names = ["token", "id", "label", "size_at", *(f"p{i}" for i in range(WORDS))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token and size; of a group that goes on, only rows within reach of the next size are held."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [longs(batch, c) for c in names]
            held = 0
            if rest is not None:
                held = len(rest[0])
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            token, own, label, packed = cols[:4]
            n, at = packed >> 32, packed & 0xFFFFFFFF
            active, d = np.arange(len(token)), 1
            if len(token):  # a group of one label has no pair
                new = np.concatenate([[True], token[1:] != token[:-1]])
                group = np.cumsum(new) - 1
                first = np.nonzero(new)[0]
                active = active[(np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first))[group]]
            while len(active):
                active = active[active + d < len(token)]
                other = active + d
                near = (token[other] == token[active]) & (100 * n[active] >= percent * n[other])
                active, other = active[near], other[near]  # sorted by size: who is out of reach stays so
                i, j = active[other >= held], other[other >= held]
                need = overlap(n[i], n[j], percent)
                ok = (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & (label[i] != label[j])
                i, j, need = i[ok], j[ok], need[ok]
                apart = sum((np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in cols[4:]), np.zeros(len(i), np.int64))
                ok = apart <= n[i] + n[j] - 2 * need
                a, b = own[i[ok]], own[j[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                d += 1
            keep = (token == token[-1]) & (100 * n >= percent * n[-1]) if len(token) else np.zeros(0, bool)
            rest = [c[keep] for c in cols]

    found = arrow_map(entries.repartition("token").sortWithinPartitions("token", "size_at"), kernel, "a long, b long")
    return found.distinct()
