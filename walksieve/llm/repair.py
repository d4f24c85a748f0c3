"""Token shards compressed by Re-Pair, with random access.

A shard holds the ids of consecutive documents. Frequent neighbouring pairs are
replaced by nonterminals in rounds: in each round pairs are counted over the whole
shard, and where two of them overlap the more frequent one is taken, leftmost first
among equals. The rules and their expansion lengths are stored with the remaining
sequence, so any range of ids is found by a search in the running lengths and only
the symbols that cover it are expanded.

Nulls are empty texts (one end id). Repeated rows are written as often as they
occur; rows without a doc_id come first. An empty table gives no shard; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.llm.tokens import encoder, pieces

MAGIC = b"RPR1"
ROUNDS = 6
LEAST = 6                 # a pair is replaced if it occurs so often
SHARD_IDS = 1 << 18


def frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur `least` times or more, by falling count, then by pair, and for
    every place which of them it is; their number where it is none."""
    bits, kind = len(keys).bit_length(), np.int32 if len(keys) < 1 << 31 else np.int64
    # a pair is as rare as its bucket, so most rare ones are left out before the sort
    bucket = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    held = np.flatnonzero((np.bincount(bucket) >= least)[bucket])
    if not len(held):
        return keys[:0], np.zeros(len(keys), dtype=kind)
    some, place = keys[held], np.arange(len(held), dtype=np.uint64)
    if int(some.max()) < 1 << (64 - bits):       # a pair and its place fit one number, which sorts faster
        both = np.sort(some << np.uint64(bits) | place)
        ordered, order = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).view(np.int64)
    else:
        order = np.argsort(some, kind="stable")
        ordered = some[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(begin, len(some)))
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(-count[often], kind="stable")]
    rank = np.full(len(count), len(often), dtype=kind)
    rank[often] = np.arange(len(often), dtype=kind)
    at = np.full(len(keys), len(often), dtype=kind)
    at[held[order]] = np.repeat(rank, count)
    return ordered[begin[often]], at


def compress(ids: np.ndarray, first_free: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remaining sequence, the rules (n, 2) and their expansion lengths."""
    seq, lengths = ids.astype(np.uint32), np.empty(0, np.int64)
    # here nonterminals follow the ids that occur, so that a pair is a small number
    gap = first_free - (int(seq.max()) + 1 if len(seq) else 0)
    terminals, rules = np.uint64(first_free - gap), [np.empty((0, 2), np.uint64)]
    for _ in range(rounds):
        if len(seq) < 2:
            break
        wide = np.uint64((int(terminals) + len(lengths)).bit_length())
        pairs, at = frequent_pairs(seq[:-1].astype(np.uint64) << wide | seq[1:], least)
        held = at < len(pairs)
        chosen = held.copy()
        chosen[1:] &= at[1:] <= at[:-1]
        chosen[:-1] &= at[:-1] <= at[1:]
        # in a run of one pair (a a a a) every other place
        again = np.flatnonzero((at[1:] == at[:-1]) & held[1:]) + 1
        if len(again):
            starts = np.maximum.accumulate(np.where(np.append(True, np.diff(again) > 1), again - 1, 0))
            chosen[again[(again - starts) % 2 == 1]] = False
        taken = np.flatnonzero(chosen)
        which = at[taken]
        good = np.bincount(which, minlength=len(pairs)) >= max(least // 2, 1)
        taken, which = taken[good[which]], (np.cumsum(good) - 1)[which[good[which]]]
        if not len(taken):
            break
        new = np.stack((pairs[good] >> wide, pairs[good] & ((np.uint64(1) << wide) - np.uint64(1))), axis=1)
        sizes = np.ones(new.shape, dtype=np.int64)
        sizes[new >= terminals] = lengths[(new[new >= terminals] - terminals).astype(np.int64)]
        seq[taken] = (which + int(terminals) + len(lengths)).astype(np.uint32)
        stay = np.ones(len(seq), dtype=bool)
        stay[taken + 1] = False
        seq = seq[stay]
        rules.append(new)
        lengths = np.concatenate((lengths, sizes.sum(axis=1)))
    named = lambda s: np.where(s >= terminals, s.astype(np.int64) + gap, s).astype(np.uint32)
    return named(seq), named(np.concatenate(rules)), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first_free: int) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    while (open_ := symbols >= first_free).any():
        width = np.where(open_, 2, 1)
        out = np.repeat(symbols, width)
        at = np.cumsum(width) - width
        pair = rules[symbols[open_] - first_free]
        out[at[open_]], out[at[open_] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


class Shard:
    """One shard file: written by `pack`, read by ranges of ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("these bytes do not begin like a shard")
        docs, rules, symbols, self.first_free = np.frombuffer(raw, "<i8", 4, 4).tolist()
        at = 36

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            begin, at = at, at + n * np.dtype(kind).itemsize
            return np.frombuffer(raw[begin:at], kind)        # a copy, so that its numbers are aligned

        self.known, self.doc_ids, self.starts = take("u1", docs), take("<i8", docs), take("<i8", docs + 1)
        self.rules, self.rule_lengths, self.symbols = take("<u4", 2 * rules).reshape(-1, 2), take("<i8", rules), take("<u4", symbols)
        nonterminal = self.symbols >= self.first_free
        lengths = np.ones(symbols, dtype=np.int64)
        lengths[nonterminal] = self.rule_lengths[self.symbols[nonterminal] - self.first_free]
        self.ends = np.cumsum(lengths)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from `start` up to `end`, expanding only what covers them."""
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, end, "left"))
        before = int(self.ends[first - 1]) if first else 0
        return expand(self.symbols[first:last + 1], self.rules, self.first_free)[start - before:end - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> list[np.ndarray]:
        """All documents, from one expansion of each rule."""
        bounds = self.starts.tolist()
        bodies = expand(np.arange(self.first_free, self.first_free + len(self.rules), dtype="<u4"), self.rules, self.first_free)
        # what a symbol stands for lies in one table: first the ids that occur as they are, then the rules
        plain = self.symbols < self.first_free
        table = np.concatenate((self.symbols[plain], bodies)).astype("<u4", copy=False)
        rule_at = np.cumsum(self.rule_lengths) - self.rule_lengths + int(plain.sum())
        lies = np.empty(len(self.symbols), dtype=np.int64)
        lies[plain] = np.arange(int(plain.sum()))
        lies[~plain] = rule_at[self.symbols[~plain] - self.first_free]
        lengths = np.diff(self.ends, prepend=0)
        ids = table[np.repeat(lies - self.ends + lengths, lengths) + np.arange(bounds[-1])]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def pack(doc_ids: list[int | None], texts: list[np.ndarray], first_free: int) -> bytes:
    """A shard file of the given documents' ids."""
    seq, rules, lengths = compress(np.concatenate(texts), first_free)
    head = np.array([len(doc_ids), len(rules), len(seq), first_free], dtype="<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    parts = known, np.array([d or 0 for d in doc_ids], "<i8"), starts.astype("<i8"), rules.astype("<u4"), lengths.astype("<i8"), seq.astype("<u4")
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, first_free: int = 1 << 17) -> None:
    """Encode every whole text, append `end_id`, and write shards in ascending doc_id order.

    The rows are cut into ranges of doc_id (rows of one doc_id may be spread by their
    text's hash). Each row of the written table is one shard file: `part`, `shard` (its
    number in the part), `n_tokens` and the file's bytes. The table's own commit makes
    a repeated task harmless.
    """
    def make(batches):
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[np.ndarray] = []
        held = 0

        def shard():
            rows = [[part], [number], [held], [pack(ids, texts, first_free)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "shard", "n_tokens", "payload"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, some in pieces(batch.column(1)):
                for name, raw in zip(names[a:b], coder.encode(some)):
                    ids.append(name)
                    texts.append(np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
                    held += len(texts[-1])
                    if held >= SHARD_IDS:
                        yield shard()
                        ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield shard()

    ranged = documents(docs, "doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(make, "part int, shard int, n_tokens long, payload binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "shard", "n_tokens")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("in_part")).join(parts, "part")
    begins = begins.select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("base"))

    def decode(batches):
        for batch in batches:
            for part, number, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard(raw)
                sums = [zlib.crc32(ids) for ids in shard.documents()]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)),
                    pa.array(shard.doc_ids, mask=shard.known == 0), pa.array(shard.starts[:-1]),
                    pa.array(np.diff(shard.starts)), pa.array(sums, pa.int64())],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = files.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(begins, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
