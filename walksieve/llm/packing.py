"""Packing to a mixture: deficit round-robin over source queues, window by window.

Every source is a queue of its documents' ids. A window of `size` tokens is filled in
rounds: source j is credited with its share of the window, adds what it was left with, is
served whole tokens, and keeps its deficit for the next window. The fraction that a source
is not served passes to the one after it, so that the last one fills the window: after k
windows of one set of weights the first j sources together have been served
floor(size * k * (w_1 + ... + w_j)) tokens, and no source is ever a token away from its share.

That makes the schedule a formula: where a token lies follows from its place in its
queue, in any task, and deficits are carried over windows and partitions alike. When a
source runs dry, the window in which it does is filled by the others in the same
proportions, and a new phase with the remaining weights begins; there are at most two
phases per source. What is left after the last full window is cut into windows whose
sizes are powers of two, so nothing is padded.

Weights are shares of UNITS (at least one unit each). Sources that the targets do not
name, or name with 0, come after the named ones, by their own token counts. A null source
is a source. A null text is empty and has one id, the end id; repeated rows are packed as
often as they occur; an empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.llm.tokens import encoder, some_at_a_time
from walksieve.session import written

SIZE = 2048
UNITS = 1 << 20


@dataclass(frozen=True)
class Phase:
    """`windows` windows of `size` tokens from sequence `first` on; after k of them the first
    j sources have been served k * top[j] // below tokens, from `begin[j]` of their queues on."""

    first: int
    windows: int
    top: np.ndarray         # (sources + 1)
    below: int
    begin: np.ndarray       # (sources)

    def served(self, j, k):
        """Tokens of source j in the phase's first k windows."""
        return k * self.top[j + 1] // self.below - k * self.top[j] // self.below

    def before(self, j, k):
        """Where source j's tokens begin in window k."""
        return (k + 1) * self.top[j] // self.below - k * self.top[j] // self.below

    def window_of(self, j: int, t: np.ndarray) -> np.ndarray:
        """The window that holds each of source j's tokens `t`, counted in the phase."""
        share = int(self.top[j + 1] - self.top[j])
        low = np.maximum((t - 1) * self.below // share - 1, 0)
        high = np.minimum((t + 2) * self.below // share + 1, self.windows - 1)
        while (open_ := low < high).any():      # the first window after which more than t are served
            mid = (low + high) // 2
            enough = self.served(j, mid + 1) > t
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low


def in_units(weights: list[float], units: int = UNITS) -> list[int]:
    """Whole shares of `units` that follow the weights; none is 0 that has a weight."""
    live = [i for i, w in enumerate(weights) if w > 0]
    units = max(units, 2 * len(live))
    total = sum(weights[i] for i in live)
    exact = [weights[i] / total * units for i in live]
    whole = [max(1, int(x)) for x in exact]
    rest = sorted(range(len(live)), key=lambda n: whole[n] - exact[n])
    for n in range(units - sum(whole)):
        whole[rest[n % len(rest)]] += 1
    while sum(whole) > units:
        whole[max(range(len(whole)), key=whole.__getitem__)] -= 1
    out = [0] * len(weights)
    for i, n in zip(live, whole):
        out[i] = n
    return out


def schedule(tokens: list[int], targets: list[float], size: int = SIZE) -> list[Phase]:
    """The phases that serve all `tokens` of the queues to the `targets` (0: after the others)."""
    left, phases, first = [int(n) for n in tokens], [], 0

    def serve(tops: list[int], below: int, windows: int):
        nonlocal first, left
        begin = np.array([n - r for n, r in zip(tokens, left)], dtype=np.int64)
        phase = Phase(first, windows, np.array(tops, dtype=np.int64), below, begin)
        phases.append(phase)
        left = [r - int(phase.served(j, windows)) for j, r in enumerate(left)]
        first += windows

    def exact(given: list[int]):
        serve(np.concatenate(([0], np.cumsum(given))).tolist(), 1, 1)

    def weights_now() -> list[int]:
        named = [w if r else 0 for w, r in zip(targets, left)]
        return in_units(named if any(named) else left)

    while sum(left) >= size:
        units = weights_now()
        shared = gcd(size, sum(units))
        below, tops = sum(units) // shared, [0]
        for u in units:
            tops.append(tops[-1] + u * (size // shared))
        share = lambda j, k: k * tops[j + 1] // below - k * tops[j] // below
        windows = None
        for j in (j for j, u in enumerate(units) if u):
            low, high = 0, (left[j] + 2) * below // (tops[j + 1] - tops[j]) + 2
            while low < high:                   # the most windows that the queue lasts
                mid = (low + high + 1) // 2
                low, high = (mid, high) if share(j, mid) <= left[j] else (low, mid - 1)
            windows = low if windows is None else min(windows, low)
        if windows:
            serve(tops, below, windows)
            continue
        given, room = [0] * len(left), size     # a source runs dry within this window
        while room:
            rest = [r - g for r, g in zip(left, given)]
            named = [w if r else 0 for w, r in zip(targets, rest)]
            units = in_units(named if any(named) else rest)
            done = upto = 0
            for j, u in enumerate(units):
                upto += u
                more = min(rest[j], room * upto // sum(units) - done) if u else 0
                done = room * upto // sum(units)
                given[j] += more
            room = size - sum(given)
        exact(given)
    while (room := sum(left)):                  # powers of two, the largest first
        room = 1 << (room.bit_length() - 1)
        given, upto, total, done = [], 0, sum(left), 0
        for r in left:
            upto += r
            given.append(room * upto // total - done)
            done += given[-1]
        exact(given)
    return phases


def tokens_of(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, keys: tuple[str, ...] = ("doc_id", "source")) -> None:
    """Encode every whole text once, append `end_id`, and write doc_id, source, part (the task),
    inside (ids of the source's earlier documents in the task) and ids.

    Texts stay in the task that reads them; the table's own commit makes a repeated task harmless.
    """
    named = documents(docs, *keys, "text")

    def make(batches):
        coder, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        upto: dict = {}
        for batch in batches:
            sources, column = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in some_at_a_time(column, 6_000_000):
                ids, inside = [x + end for x in coder.encode(column[a:b])], []
                for source, x in zip(sources[a:b], ids):
                    inside.append(upto.get(source, 0))
                    upto[source] = inside[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                    pa.array(inside, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "inside", "n", "ids"])

    id_type, source_type = (named.schema[k].dataType.simpleString() for k in keys)
    named.mapInArrow(make, f"doc_id {id_type}, source {source_type}, part int, inside long, n long, ids binary").write.parquet(path)


def _pieces(phases: list[Phase], j: int, starts: np.ndarray, counts: np.ndarray):
    """Pieces of source j's documents whose ids begin at `starts` of its queue.

    Returns document, start in it, length, sequence and offset.
    """
    ends, found = starts + counts, [np.empty((5, 0), dtype=np.int64)]
    for phase in phases:
        a = int(phase.begin[j])
        b = a + int(phase.served(j, phase.windows))
        doc = np.flatnonzero((starts < b) & (ends > a))
        if not len(doc):
            continue
        low, high = np.maximum(starts[doc], a) - a, np.minimum(ends[doc], b) - a
        if phase.top[j + 1] - phase.top[j] >= phase.below:
            k = phase.window_of(j, low)
            times = phase.window_of(j, high - 1) - k + 1
        else:                                   # less than a token a window: by token
            times = high - low
        of = np.repeat(np.arange(len(doc)), times)
        step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        k = k[of] + step if phase.top[j + 1] - phase.top[j] >= phase.below else phase.window_of(j, low[of] + step)
        first = phase.served(j, k)
        begin = np.maximum(first, low[of])
        length = np.minimum(phase.served(j, k + 1), high[of]) - begin
        if phase.top[j + 1] - phase.top[j] < phase.below:
            begin, length = low[of] + step, np.ones(len(of), dtype=np.int64)
        found.append(np.stack((doc[of], begin + a - starts[doc][of], length, k + phase.first, phase.before(j, k) + begin - first)))
    return np.concatenate(found, axis=1)


def pack(spark: SparkSession, path: str, targets: dict | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of the documents stored under `path`: doc_id, source, start, length, ids (binary,
    little-endian), doc_tokens, sequence_id, offset.

    `targets` are weights by source; without them every window gets the shares that the
    sources have of all tokens. The driver sees one row per source.
    """
    stored = spark.read.parquet(path)
    parts = written(stored.groupBy("part", "source").agg(F.sum("n").alias("n")), "queues")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queues = written(parts.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "queue-starts")
    totals = sorted(parts.groupBy("source").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["source"] is None, str(r["source"])))
    sources, tokens = [r["source"] for r in totals], [r["n"] for r in totals]
    wanted = [float((targets or {}).get(s, 0)) for s in sources] if targets is not None else [float(n) for n in tokens]
    phases = schedule(tokens, wanted, size)
    place = {s: j for j, s in enumerate(sources)}

    def cut(batches):
        for batch in batches:
            owner = np.array([place[s] for s in batch.column(1).to_pylist()], dtype=np.int64)
            starts, counts = (batch.column(k).to_numpy() for k in (2, 3))
            found = []
            for j in np.unique(owner):
                own = np.flatnonzero(owner == j)
                pieces = _pieces(phases, int(j), starts[own], counts[own])
                pieces[0] = own[pieces[0]]
                found.append(pieces)
            if not found:
                continue
            found = np.concatenate(found, axis=1)
            doc, start, length, sequence, offset = found[:, np.lexsort((found[1], found[0]))]
            # pieces in order are the batch's ids in order
            ids, edges = b"".join(batch.column(4).to_pylist()), np.append(0, np.cumsum(4 * length))
            for at in range(0, len(doc), 65536):
                s = slice(at, at + 65536)
                low, high = int(edges[at]), int(edges[min(at + 65536, len(doc))])
                told = edges[at:at + len(doc[s]) + 1] - low
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc[s])), batch.column(1).take(pa.array(doc[s])), pa.array(start[s]), pa.array(length[s]),
                    pa.Array.from_buffers(pa.binary(), len(told) - 1, [None, pa.py_buffer(told.astype(np.int32)), pa.py_buffer(ids[low:high])]),
                    pa.array(counts[doc[s]]), pa.array(sequence[s]), pa.array(offset[s])],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    id_type, source_type = (stored.schema[k].dataType.simpleString() for k in ("doc_id", "source"))
    schema = f"doc_id {id_type}, source {source_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    d, q = stored.alias("d"), queues.alias("q")
    based = d.join(q, (F.col("d.part") == F.col("q.part")) & F.col("d.source").eqNullSafe(F.col("q.source")))
    return based.select("doc_id", "d.source", (F.col("base") + F.col("inside")).alias("begin"), "n", "ids").mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed windows themselves, each at most a window's pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.array_join(F.transform(ordered, lambda p: F.hex(p["ids"])), "").alias("hex")) \
        .select("sequence_id", F.unhex("hex").alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """What is told of each piece without its ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
