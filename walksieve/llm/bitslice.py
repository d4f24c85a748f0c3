"""Hamming distances over bit planes: 64 comparisons per machine word.

Fingerprints are stored vertically: plane p holds bit p of 64 fingerprints per
word. One row against one word of lanes is an *entry*. The distances of an entry's
64 lanes are counted in bit planes too, two input planes at a time through a
carry-save adder. Counters start at such a value that a carry out of the top means
"more than the radius"; entries in which all lanes have overflown are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bits_of(fingerprints: np.ndarray) -> np.ndarray:
    """(n, bytes) to (n, bits) of 0 and 1, highest bit first."""
    return np.unpackbits(fingerprints, axis=1)


def planes_of(bits: np.ndarray, lanes: np.ndarray, words: int) -> np.ndarray:
    """Vertical planes (bits, words); fingerprint i goes to lane `lanes[i]`."""
    laid = np.zeros((words * 64, bits.shape[1]), dtype=np.uint8)
    laid[lanes] = bits
    return np.ascontiguousarray(np.packbits(laid.T, axis=1, bitorder="little")).view(np.uint64)


def near(bits: np.ndarray, planes: np.ndarray, rows: np.ndarray, words: np.ndarray, valid: np.ndarray,
         radius: int, slab: int = 32768, look: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, lane, distance) of all compared pairs within the radius, slab by slab.

    Entry i compares `bits[rows[i]]` with the lanes of word `words[i]`; `valid` has
    a one for each lane that counts.
    """
    size = max(1, int(radius).bit_length())
    bias = 2**size - 1 - radius
    for at in range(0, len(rows), slab):
        row, word, over = rows[at:at + slab], words[at:at + slab], ~valid[at:at + slab]
        counter = [np.full(len(row), FULL if bias >> k & 1 else 0, dtype=np.uint64) for k in range(size)]
        for p in range(0, planes.shape[0], 2):
            first = planes[p][word] ^ (np.uint64(0) - bits[row, p].astype(np.uint64))
            second = planes[p + 1][word] ^ (np.uint64(0) - bits[row, p + 1].astype(np.uint64))
            half = first ^ second
            carry = (first & second) | (counter[0] & half)
            counter[0] = counter[0] ^ half
            for k in range(1, size):
                carry, counter[k] = counter[k] & carry, counter[k] ^ carry
            over |= carry
            if p % look == look - 2:
                alive = over != FULL
                if not alive.all():
                    row, word, over = row[alive], word[alive], over[alive]
                    counter = [c[alive] for c in counter]
                if not len(row):
                    break
        if not len(row):
            continue
        hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        entry, lane = np.nonzero(hit)
        shift = lane.astype(np.uint64)
        distance = np.zeros(len(entry), dtype=np.int64)
        for k in range(size):
            distance += ((counter[k][entry] >> shift) & np.uint64(1)).astype(np.int64) << k
        yield row[entry], word[entry] * 64 + lane, distance - bias


def joined_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each connected class after the given links are added."""
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return labels
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := labels[labels], labels):
            labels = further
