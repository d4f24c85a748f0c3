import math
import zlib
from collections import Counter, defaultdict

import pytest

from walksieve.llm import mixing, queries, ring

from .conftest import SF


def words(text):
    return len((text or "").encode().split())


def check_mixture(rows, given_rows, limit):
    """Brute-force check of a mixture against its budgets; rows are in stream order per source."""
    tokens, count = Counter(), Counter()
    for d, t, s in given_rows:
        tokens[s] += words(t)
        count[s] += 1
    streams = defaultdict(list)
    for r in rows:
        streams[r.source].append(r)
    assert streams.keys() == count.keys()
    repeats = {}
    for s, stream in streams.items():
        epochs = defaultdict(list)
        for r in stream:
            epochs[r.epoch].append(r)
        want = Counter((d, words(t)) for d, t, s2 in given_rows if s2 == s)
        for e, taken in epochs.items():
            at = e * tokens[s]
            for r in sorted(taken, key=lambda r: (r.start, r.n_tokens)):
                assert r.start == at
                at += r.n_tokens
            got = Counter((r.doc_id, r.n_tokens) for r in taken)
            assert got == want if e < max(epochs) or at == (e + 1) * tokens[s] else not got - want
        total = sum(r.n_tokens for r in stream)
        largest = max((n for _, n in want), default=0)
        assert stream[0].budget - largest <= total <= stream[0].budget
        if tokens[s]:
            repeats[s] = stream[0].budget / tokens[s]
    assert min(repeats.values()) == pytest.approx(1, abs=1e-3)
    assert max(repeats.values()) <= limit * 1.001
    return tokens, repeats


def test_query_meets_the_limit_with_whole_epochs(spark, given):
    rows = queries.op3_temperature_mixing(spark, SF).collect()
    docs = [(r.doc_id, r.text, r.source) for r in given("documents").collect()]
    tokens, repeats = check_mixture(rows, docs, 2.0)
    # the exponent: weights are powers of the shares
    hot, small = max(tokens, key=tokens.get), min(tokens, key=tokens.get)
    a = 1 + math.log(repeats[hot] / repeats[small]) / math.log(tokens[hot] / tokens[small])
    for s in tokens:
        assert repeats[s] / repeats[hot] == pytest.approx((tokens[s] / tokens[hot]) ** (a - 1), rel=5e-3)


def rows_of():
    out = [(i, "a b c d " * (1 + i % 5), "en", "hot") for i in range(3000)]
    out += [(5000 + i, "x y " * (1 + i % 3), "en", f"s{i % 4}") for i in range(200)]
    return out + [(9000, None, "en", "empty"), (9001, "", "en", "empty"), (9002, "one", "en", None), (None, "two three", "en", None), (9003, "p q", "en", "s1"), (9003, "p q", "en", "s1")]


def test_skewed_odd_and_repeated_rows(docs_of):
    docs = docs_of(rows_of())
    target = mixing.Target(repetitions=3.5)
    got = mixing.mixture(docs, target).collect()
    check_mixture(got, [(r[0], r[1], r[3]) for r in rows_of()], 3.5)
    mixed = mixing.mixed_documents(docs, target)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter((r.doc_id, r.source) for r in got)


def test_entropy_is_met(spark, docs_of):
    docs = docs_of(rows_of())
    table = mixing.budgets(mixing.sizes(docs), mixing.Target(entropy=1.2)).where("tokens > 0").collect()
    assert -sum(r.weight * math.log(r.weight) for r in table) == pytest.approx(1.2, abs=1e-4)


def test_nothing_to_mix(docs_of):
    assert mixing.mixture(docs_of([]), mixing.Target(repetitions=2.0)).count() == 0
    assert mixing.mixed_documents(docs_of([]), mixing.Target(repetitions=2.0)).count() == 0
    only = docs_of([(1, None), (2, "")])
    assert mixing.mixed_documents(only, mixing.Target(repetitions=2.0)).count() == 2


def plain_walk(counts, shards, room):
    """Row by row: every waiting row asks its node in turns; nearer rows first."""
    nodes = ring.virtual_nodes(shards)
    room = list(room)
    waiting = []
    for slot in sorted(counts):
        node = next((k for k, (at, _) in enumerate(nodes) if at >= slot), 0)
        waiting += [(node, slot, rank) for rank in range(counts[slot])]
    out = {}
    while waiting:
        over = []
        for node, slot, rank in sorted(waiting):
            s = nodes[node][1]
            if room[s]:
                room[s] -= 1
                out[slot, rank] = s
            else:
                over.append((node, slot, rank))
        waiting = []
        for node, slot, rank in over:
            node = (node + 1) % len(nodes)
            while not room[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            waiting.append((node, slot, rank))
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ranges_equal_a_walk_row_by_row(slack):
    counts = {(k * 2654435761) % ring.SLOTS: 1 + k % 7 for k in range(300)} | {77: 900}
    room = ring.capacities(sum(counts.values()), 7, slack)
    ranges = ring.walk(counts, 7, room)
    got, places = {}, defaultdict(list)
    for slot, lo, hi, shard, first in ranges:
        for rank in range(lo, hi):
            got[slot, rank] = shard
            places[shard].append(first + rank - lo)
    assert got == plain_walk(counts, 7, room)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(p) <= room[s] for s, p in places.items())


def test_query_keeps_its_law(spark, given):
    rows = {r.doc_id: r for r in queries.op4_bounded_ring(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in given("documents").collect()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        raw = (docs[d] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    by_shard = defaultdict(list)
    for r in rows.values():
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) == set(range(40)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_odd_rows_are_all_placed_and_few_move(docs_of):
    rows = [(i, f"text {i % 50}") for i in range(2000)] + [(None, None), (None, ""), (None, "x"), (7, "text 7"), (7, "text 7")] + [(42, "same")] * 500
    docs = docs_of(rows)
    got = ring.placed(docs, 10)
    assert set(got.columns) == set(docs.columns) | {"shard", "slot"}
    sizes = Counter(r.shard for r in got.collect())
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    place = lambda n: {r.doc_id: r.shard for r in ring.placed(docs_of(rows[:2000]), n, 0.1).collect()}
    before, after = place(10), place(11)
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert moved < 0.35         # a modulo of the hash moves 0.91
    assert ring.placed(docs_of([]), 10).count() == 0 and ring.shards(docs_of([(1, "a")])).collect()[0].slot == 0


def test_equal_rows_at_the_border_of_a_budget(docs_of):
    """A hundred equal rows of a source, of which half fit once more: the stage takes as many as the query."""
    rows = [(7, "a b c d", "en", "hot")] * 100 + [(i, "x " * 40, "en", "other") for i in range(200, 300)]
    docs = docs_of(rows)
    for repetitions in (1.5, 1.27):
        target = mixing.Target(repetitions=repetitions)
        got = mixing.mixture(docs, target).collect()
        mixed = mixing.mixed_documents(docs, target).collect()
        assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in got)
        assert 100 < sum(r.doc_id == 7 for r in mixed) < 200
