"""Benchmark decontamination: short test items found inside long documents.

Containment is |item's shingles in the document| / |item's shingles|, of different
five-word shingles. Candidates come from MinHash signatures partitioned by size: an
item of up to L = 2^c shingles belongs to class c, and for each class a document is
seen as overlapping stretches of 2 L shingles (half of each shared with the next), or as
a whole if it is shorter. So sizes within a class differ by a bounded factor, and the
Jaccard similarity that a containment of `least` implies is at least
least * L/2 / (2 L + (1 - least) * L/2) = 0.19 for 0.8; one of 48 minima then
agrees with probability over 0.9999. Minima of a stretch are minima of its blocks, so
every shingle is hashed 48 times only, whatever the number of classes. Candidates are
verified on the whole document by its actual shingles.

A text with fewer than five words is one shingle of all its words; an item without
words, or a null, matches nothing. Repeated rows give one result each. Empty tables
give empty results. Extra columns are carried by `without_leaks` and ignored else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walksieve.llm.common import documents, mixed, raw_texts, shingle_spans, words_of

WORDS = 5
LEAST = 0.8
MINIMA = 48
BLOCK = 16                      # shingles of the smallest class
ITEM_BYTES = 16_000_000         # item text that one scan of the documents carries, about
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = mixed(np.arange(MINIMA, dtype=np.uint64), 1) | np.uint64(1)
_MASKS = mixed(np.arange(MINIMA, dtype=np.uint64), 2)
_SALTS = mixed(np.arange(MINIMA, dtype=np.uint64), 3)
_FILTER_BITS = 22


def _hashed(joined: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends)]), ">u8").astype(np.uint64)


def block_minima(hashes: np.ndarray) -> np.ndarray:
    """(MINIMA, blocks): the smallest value of each hash function in each block of shingles."""
    out = []
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096]
        values = (part ^ _MASKS[:, None]) * _FACTORS[:, None]
        if spare := -len(part) % BLOCK:
            values = np.concatenate((values, np.full((MINIMA, spare), _TOP)), axis=1)
        out.append(values.reshape(MINIMA, -1, BLOCK).min(axis=2))
    return np.concatenate(out, axis=1)


def size_class(shingles: int) -> int:
    """0 for up to BLOCK shingles, one more for each doubling."""
    return max(0, (shingles - 1).bit_length() - (BLOCK - 1).bit_length())


class Items:
    """A block of test items with their signatures, small enough to go to every task."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.names: list[int | None] = []
        self.shingles: list[set[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, text in items:
            joined, starts, ends = shingle_spans(words_of(None if text is None else text.encode()), WORDS)
            if not starts:
                continue
            own = {joined[s:e] for s, e in zip(starts, ends)}
            minima = block_minima(_hashed(joined, starts, ends)).min(axis=1)
            found.setdefault(size_class(len(own)), []).append((self._keys(minima[:, None])[:, 0], np.full(MINIMA, len(self.names))))
            self.names.append(name)
            self.shingles.append(own)
        self.classes = {}
        for c, parts in found.items():
            keys, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.classes[c] = keys[order], item[order], seen

    @staticmethod
    def _keys(minima: np.ndarray) -> np.ndarray:
        return (minima ^ _SALTS[:, None]) * np.uint64(0x9E3779B97F4A7C15)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items one of whose minima agrees with that of a stretch of their class."""
        blocks, level, out = block_minima(hashes), 0, set()
        for c in sorted(self.classes):
            while level < c:
                if blocks.shape[1] % 2:
                    blocks = np.concatenate((blocks, np.full((MINIMA, 1), _TOP)), axis=1)
                blocks, level = np.minimum(blocks[:, ::2], blocks[:, 1::2]), level + 1
            stretches = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            keys, item, seen = self.classes[c]
            asked = self._keys(stretches).ravel()
            asked = asked[seen[(asked & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]]
            for lo, hi in zip(np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")):
                out.update(item[lo:hi].tolist())
        return out

    def leaks(self, text: bytes | None, least: float) -> list[tuple[int, int]]:
        """(item's place, shared shingles) of the items that the whole text contains."""
        joined, starts, ends = shingle_spans(words_of(text), WORDS)
        if not starts or not self.classes:
            return []
        asked = self.candidates(_hashed(joined, starts, ends))
        if not asked:
            return []
        own = {joined[s:e] for s, e in zip(starts, ends)}
        shared = ((i, len(own & self.shingles[i])) for i in sorted(asked))
        return [(i, n) for i, n in shared if n >= least * len(self.shingles[i])]


def item_blocks(items: DataFrame) -> list[Items]:
    """The test items in blocks of about ITEM_BYTES; each block is one scan of the documents."""
    named = documents(items, "item_id", "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [Items([tuple(r) for r in named.where(of == k).collect()]) for k in range(blocks)]


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """item_id, doc_id, shared, item_shingles, containment of every item in every document."""
    out = None
    for block in item_blocks(items):
        def find(batches, block=block):
            for batch in batches:
                rows = [(block.names[i], d, n, len(block.shingles[i])) for d, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))) for i, n in block.leaks(t, least)]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "shared", "item_shingles"])

        found = documents(docs, "doc_id", "text").mapInArrow(find, "item_id long, doc_id long, shared long, item_shingles long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def without_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, that contain no item."""
    at = docs.columns.index("text")
    for block in item_blocks(items):
        def keep(batches, block=block):
            for batch in batches:
                yield batch.filter(pa.array([not block.leaks(t, least) for t in raw_texts(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
