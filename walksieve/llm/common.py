"""What several operators share: whole texts as bytes, shingle hashes, settings of a job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; nothing for a null."""
    return [] if text is None else text.lower().split()


def shingle_spans(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each run of `width` words starts and ends.

    Fewer words than `width` give one run with all of them; no words, none.
    """
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    if len(words) <= width:
        return joined, [0], [len(joined)]
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `width` words of a whole text, repeats included (uint64)."""
    joined, starts, ends = shingle_spans(words_of(text), width)
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends)])
    return np.frombuffer(found, dtype=">u8").astype(np.uint64)


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Another well-mixed 64-bit number for each of `values`, by salt."""
    x = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def as_text_key(column):
    """crc32 of a key's decimal text; null for a null key."""
    return F.crc32(column.cast("string").cast("binary"))
