"""Token counts from flat token files that have no index.

A token file is a run of ids in which a separator ends each document. It is read in
blocks of a fixed number of ids, whose borders fall anywhere in a document. Each block
is searched for separators on its own; a running sum and a running maximum over the
blocks' short summaries then tell how many documents ended before a block and where
the document that is open at its start began.

Nulls and empty texts are documents without ids. An empty table gives an empty
result; repeated rows are counted each; extra columns are not read. Ids after a
file's last separator are a last document that is not complete.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents

BLOCK_IDS = 1 << 16
_coders: dict = {}


def _ranks(path: str, pattern: str, separator: int):
    """One byte-pair encoder per worker; no text can produce the separator."""
    if path not in _coders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if separator in ranks.values():
            raise ValueError("the separator is an id of a text")
        _coders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path]


def write_flat(docs: DataFrame, path: str, ranks: str, pattern: str, separator: int, block_ids: int = BLOCK_IDS) -> None:
    """One flat token file per partition, stored in blocks, with the names of its documents in order.

    A row is either a block (`file`, `block`, `payload`) or a list of names
    (`file`, `first`: the place of the first in the file, `names`). Where documents
    begin or end is not stored.
    """
    def make(batches):
        coder, file = _ranks(ranks, pattern, separator), TaskContext.get().partitionId()
        held, size, block, first = [], 0, 0, 0

        def rows(blocks: list[bytes], names: list, number: int, place: int):
            n = len(blocks)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + 1), pa.int32()), pa.array([*range(number, number + n), None], pa.int64()),
                pa.array([*blocks, None], pa.binary()), pa.array([None] * n + [place], pa.int64()),
                pa.array([None] * n + [names], pa.list_(pa.int64()))], names=["file", "block", "payload", "first", "names"])

        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                begin = at
                while at < len(names) and size < 16 * block_ids:
                    held.append(np.array([*coder.encode_ordinary(column[at] or ""), separator], dtype="<u4"))
                    size, at = size + len(held[-1]), at + 1
                flat = np.concatenate(held)
                whole = len(flat) // block_ids
                yield rows([flat[k * block_ids:(k + 1) * block_ids].tobytes() for k in range(whole)], names[begin:at], block, first)
                held, size, block, first = [flat[whole * block_ids:]], len(flat) % block_ids, block + whole, first + at - begin
        if size:
            yield rows([np.concatenate(held).tobytes()], [], block, first)

    documents(docs, "doc_id", "text").mapInArrow(make, "file int, block long, payload binary, first long, names array<bigint>").write.parquet(path)


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """file, place, start, n_tokens, complete: every document of the flat files.

    `blocks` has file, block (from 0) and payload (little-endian unsigned 32-bit
    ids). `place` numbers the documents of a file from 0; `start` is in ids.
    """
    def search(batches):
        for batch in batches:
            ends, sizes = [], []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw, "<u4")
                ends.append((np.flatnonzero(ids == separator) + 1).astype(np.int32))
                sizes.append(len(ids))
            offsets = np.concatenate(([0], np.cumsum([len(e) for e in ends]))).astype(np.int32)
            flat = np.concatenate(ends) if ends else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["file", "block", "size", "ends"])

    found = blocks.select("file", "block", "payload").mapInArrow(search, "file int, block long, size long, ends array<int>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(before), F.lit(0))
    stitched = found.withColumn("begin", begin).withColumn("last_end", F.col("begin") + F.try_element_at("ends", F.lit(-1)))
    stitched = stitched.select(
        "file", "begin", "ends", "size",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("place"),
        F.coalesce(F.max("last_end").over(before), F.lit(0)).alias("open_at"))
    each = stitched.select("file", "begin", "ends", "place", "open_at", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open_at")).otherwise(F.col("begin") + F.get("ends", F.col("k") - 1))
    done = each.select("file", (F.col("place") + F.col("k")).cast("long").alias("place"), start.alias("start"),
                       (F.col("begin") + F.col("end") - 1 - start).alias("n_tokens"), F.lit(True).alias("complete"))
    ended = stitched.groupBy("file").agg(
        F.max(F.col("begin") + F.col("size")).alias("total"), F.max(F.col("place") + F.size("ends")).alias("place"),
        F.max(F.col("begin") + F.try_element_at("ends", F.lit(-1))).alias("last"))
    left = ended.select("file", F.col("place").cast("long").alias("place"), F.coalesce("last", F.lit(0)).alias("start"), (F.col("total") - F.coalesce("last", F.lit(0))).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(left.where("n_tokens > 0"))


def token_counts(written: DataFrame, separator: int) -> DataFrame:
    """doc_id, file, place, start, n_tokens of what `write_flat` wrote, named by place."""
    named = written.where("names IS NOT NULL").select("file", "first", F.posexplode("names").alias("k", "doc_id"))
    named = named.select("file", (F.col("first") + F.col("k")).alias("place"), "doc_id")
    return scan(written.where("payload IS NOT NULL"), separator).where("complete").join(named, ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
