import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from walksieve.llm import packing, queries
from walksieve.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rounds(tokens, weights, size, windows):
    """Deficit round-robin, window by window: what each source is served."""
    total, deficit, out = sum(weights), [Fraction(0)] * len(weights), []
    for _ in range(windows):
        passed, served = Fraction(0), []
        for j, w in enumerate(weights):
            due = deficit[j] + Fraction(size * w, total) + passed
            n = due.__floor__()
            passed = due - n
            deficit[j] = Fraction(size * w, total) + deficit[j] - n
            served.append(n)
        assert sum(served) == size and all(abs(d) < 1 for d in deficit)
        out.append(served)
    return out


@pytest.mark.parametrize("weights", [[1.0], [1, 1, 1], [0.7, 0.2999, 0.0001], [5, 3, 2, 90], [1e-9, 1, 1]])
def test_the_formula_is_the_round_robin(weights):
    units = packing.in_units(weights)
    assert sum(units) == packing.UNITS and min(units) >= 1
    tokens = [10**7] * len(weights)
    phase = packing.schedule(tokens, weights, 2048)[0]
    plain = rounds(tokens, units, 2048, 300)
    for k, served in enumerate(plain):
        assert [int(phase.served(j, k + 1) - phase.served(j, k)) for j in range(len(weights))] == served
        assert [int(phase.before(j, k)) for j in range(len(weights))] == np.cumsum([0, *served[:-1]]).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_a_schedule_serves_every_token_once(seed):
    pick = random.Random(seed)
    tokens = [pick.choice([1, 3, 700, 5000, 40_000]) * pick.randrange(1, 9) for _ in range(pick.randrange(1, 8))]
    targets = [pick.choice([0, 1, 1, 5, 0.01]) for _ in tokens]
    phases = packing.schedule(tokens, targets, 256)
    for j, n in enumerate(tokens):
        assert sum(int(p.served(j, p.windows)) for p in phases) == n
        for p in phases:
            of = int(p.served(j, p.windows))
            if of:
                t = np.arange(of)
                k = p.window_of(j, t)
                assert (p.served(j, k) <= t).all() and (t < p.served(j, k + 1)).all()
    sizes = [sum(int(p.served(j, k + 1) - p.served(j, k)) for j in range(len(tokens))) for p in phases for k in range(p.windows)]
    assert [p.first for p in phases] == np.cumsum([0] + [p.windows for p in phases])[:-1].tolist()
    assert sizes[:sum(tokens) // 256] == [256] * (sum(tokens) // 256)
    assert all(s & (s - 1) == 0 for s in sizes) and len(phases) <= 2 * len(tokens) + 10


def packed(spark, docs, **how):
    path = scratch_path(spark, "token-blocks")
    packing.tokens_of(docs, path, TOKENIZER)
    return packing.pack(spark, path, **how)


def checked(rows, texts, size=2048):
    """The pieces give back every document and fill every sequence."""
    library = __import__("tokenizers").Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        want = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert ids == want and [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert all(r["doc_tokens"] == len(want) // 4 and 4 * r["length"] == len(r["ids"]) > 0 for r in pieces)
    lengths = []
    for sequence, pieces in sorted(by_sequence.items()):
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        lengths.append(sum(r["length"] for r in pieces))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(n == size for n in lengths[:sum(lengths) // size]) and all(n & (n - 1) == 0 for n in lengths)
    return by_sequence


def test_whole_table_to_its_mix(spark, given):
    docs = given("documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packed(spark, docs.repartition(5)).collect()
    windows = checked(rows, texts)
    total = sum(r["length"] for r in rows)
    share = {}
    for r in rows:
        share[r["source"]] = share.get(r["source"], 0) + r["length"] / total
    for k in range(total // 2048 - len(share)):
        for source, s in share.items():
            assert abs(sum(r["length"] for r in windows[k] if r["source"] == source) - 2048 * s) < 2


def test_query_is_the_digest_of_the_pieces(spark, given):
    found = queries.op11_mixture_packing(spark, "/root/testdata/sf0.001").collect()
    ids = {}
    for r in packed(spark, given("documents")).collect():
        ids[r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]] = crc32(bytes(r["ids"]))
    assert {(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]): r["ids_crc32"] for r in found} == ids


def test_targets_and_queues_that_run_dry(spark, docs_of):
    rows = [(i, "word " * (i % 50), "en", ("a", "b", None, "unnamed")[i % 4]) for i in range(400)]
    found = packed(spark, docs_of(rows), targets={"a": 3, "b": 1, None: 1, "gone": 7}, size=256).collect()
    windows = checked(found, {r[0]: r[1] for r in rows}, 256)
    first = {s: sum(r["length"] for r in windows[0] if r["source"] == s) for s in ("a", "b", None, "unnamed")}
    assert abs(first["a"] - 153.6) <= 1 and abs(first["b"] - 51.2) <= 1 and first["unnamed"] == 0


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "long " * 60_000), (4, "é" * 500), (None, "no id"), (6, "a\x00b\n\n c")]
    checked(packed(spark, docs_of(rows)).collect(), {r[0]: r[1] for r in rows})
    assert packed(spark, docs_of([]).where("false")).collect() == []
    twice = packed(spark, docs_of([(1, "same text")] * 50)).collect()
    assert sum(r["length"] for r in twice) == 50 * twice[0]["doc_tokens"]


def test_sequences_hold_their_pieces(spark, given):
    pieces = packed(spark, given("documents")).where("sequence_id < 20").collect()
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(spark.createDataFrame(pieces)).collect()}
    for k in range(20):
        assert found[k] == b"".join(bytes(r["ids"]) for r in sorted((r for r in pieces if r["sequence_id"] == k), key=lambda r: r["offset"]))
