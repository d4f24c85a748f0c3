"""Language identification with a byte convolutional network.

A text is cut into windows of WINDOW bytes. Filters of several widths slide over
the bytes of a window, each keeps its largest answer (at least 0), and a softmax over
these gives the window's languages; a text's languages are the mean of its windows'
logarithms, weighted by their bytes. The network is trained in numpy on a bounded
sample of labelled rows (DOCS_PER_LANGUAGE texts of each, WINDOWS_PER_DOC windows of
a text) and applied to all windows of all texts in batches.

A null or a text without letters is `und` with score 0, as is every text if there is
nothing to learn from. Rows with a null doc_id are classified, not learned from.
Repeated rows get equal results; equal scores go to the language first in the alphabet.
Columns with other names are carried by `only_known_languages` and ignored else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import as_text_key, documents, raw_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16                    # of each width
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
EPOCHS = 6
#: capitals as small letters, digits as one
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[ord("0"):ord("9") + 1] = ord("0")


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) folded bytes, padded with zero, and the bytes in each window."""
    raw = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[:len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1:] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]       # per width: (width, 256, FILTERS)
    weights: np.ndarray             # (filters of all widths, languages)
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest answer of every filter in every window, and where it was."""
        tops, places = [], []
        for taps in self.filters:
            span = WINDOW - len(taps) + 1
            answer = taps[0][windows[:, :span]]
            for k in range(1, len(taps)):
                answer += taps[k][windows[:, k:k + span]]
            place = answer.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(answer, place[:, None, :], axis=1)[:, 0, :])
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        """Logarithms of the languages' shares, (windows, languages)."""
        out = []
        for at in range(0, len(windows), 64):
            tops = []
            for taps in self.filters:
                span = WINDOW - len(taps) + 1
                part = windows[at:at + 64]
                answer = taps[0].take(part[:, :span], axis=0)
                for k in range(1, len(taps)):
                    answer += taps[k].take(part[:, k:k + span], axis=0)
                tops.append(answer.max(axis=1))
            z = np.maximum(np.concatenate(tops, axis=1), 0) @ self.weights + self.bias
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out).astype(np.float64)

    def classify(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and score of whole texts."""
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t.decode()))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some: list[int] = []
        held = 0
        for i in known:
            some.append(i)
            held += len(texts[i])
            if held >= 1_000_000 or i == known[-1]:
                cut = [windows_of(texts[k]) for k in some]
                shares = self.log_shares(np.concatenate([w for w, _ in cut]))
                weights = np.concatenate([s for _, s in cut])
                begins = np.cumsum([0] + [len(w) for w, _ in cut[:-1]])
                mean = np.add.reduceat(shares * weights[:, None], begins, axis=0) / np.add.reduceat(weights, begins)[:, None]
                mean = np.exp(mean - mean.max(axis=1, keepdims=True))
                mean /= mean.sum(axis=1, keepdims=True)
                for k, best, row in zip(some, mean.argmax(axis=1), mean):
                    names[k], scores[k] = self.languages[best], float(row[best])
                some, held = [], 0
        return names, scores


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 11) -> Network:
    """Fit the network by Adam on cross-entropy; `labels` are places in `languages`."""
    pick = np.random.default_rng(seed)
    filters = [pick.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for taps in filters:
        taps[:, 0, :] = 0           # padding answers nothing
    net = Network(languages, filters, pick.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*net.filters, net.weights, net.bias)]
    columns = np.arange(FILTERS)
    step = 0
    for _ in range(EPOCHS):
        order = pick.permutation(len(windows))
        for at in range(0, len(order), 128):
            chosen = order[at:at + 128]
            batch = windows[chosen]
            top, places = net.pooled(batch)
            z = top @ net.weights + net.bias
            share = np.exp(z - z.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(chosen)), labels[chosen]] -= 1
            share /= len(chosen)
            back = (share @ net.weights.T) * (top > 0)
            slopes = []
            for w, place in enumerate(places):
                slope = np.zeros_like(net.filters[w])
                own = back[:, w * FILTERS:(w + 1) * FILTERS]
                for k in range(len(slope)):
                    np.add.at(slope[k], (np.take_along_axis(batch, place + k, axis=1), np.broadcast_to(columns, own.shape)), own)
                slope[:, 0, :] = 0
                slopes.append(slope)
            slopes += [top.T @ share, share.sum(axis=0)]
            step += 1
            for value, slope, (mean, square) in zip((*net.filters, net.weights, net.bias), slopes, state):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                value -= 0.01 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id):
    """Whether a row is never learned from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(as_text_key(doc_id) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Network:
    """A network learned from text and lang of the rows that are not held out."""
    rows = documents(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([], [], np.empty((0, 0)), np.empty(0))
    # about twice as many as needed by a threshold on a hash, then the first of them
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(2**40 * min(1.0, 2 * per_language / n)))])
    near = rows.withColumn("place", place).where(F.col("place") < limit[F.col("lang")])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))))
    sample = sorted(ranked.where(F.col("rank") <= per_language).select("lang", "doc_id", "text").collect())
    languages = sorted(counts)
    windows, labels = [], []
    for lang, _, text in sample:
        cut, _ = windows_of(text.encode())
        if len(cut):
            some = cut[np.unique(np.linspace(0, len(cut) - 1, WINDOWS_PER_DOC).astype(int))]
            windows.append(some)
            labels += [languages.index(lang)] * len(some)
    if not windows:
        return Network([], [], np.empty((0, 0)), np.empty(0))
    return train(np.concatenate(windows), np.array(labels), languages)


def languages(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row's whole text."""
    def apply(batches):
        for batch in batches:
            names, scores = network.classify(raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    named = documents(docs, "doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    made = named.mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def only_known_languages(docs: DataFrame, network: Network, least: float = 0.35) -> DataFrame:
    """The rows, all columns, whose text is in a learned language with at least this score."""
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            names, scores = network.classify(raw_texts(batch.column(at)))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
