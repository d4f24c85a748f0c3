import itertools

import numpy as np
import pytest
import xxhash

from walksieve.llm import bitslice, near_copies, queries, simhash
from walksieve.llm.components import components

from .conftest import SF


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint) rows; smallest reachable doc_id per fingerprint."""
    names = sorted({f for _, f in prints})
    parent = {f: f for f in names}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    array = np.array(names, dtype=np.uint64)
    for i, f in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 2):
            a, b = root(f), root(names[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return {f: least.get(root(f)) for f in names}


def same_as_plain(rows, got):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = plain_components(prints)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([(d, f"{f:016x}", want[f]) for d, f in prints], key=key)


def test_query_equals_brute_force(spark, given):
    got = [tuple(r) for r in queries.op8_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()]
    same_as_plain([(r.doc_id, r.text) for r in given("documents").collect()], got)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one  TWO"), (6, "É é"), (7, "x y z " * 40_000), (7, "x y z " * 40_000), (None, "one two"), (8, "a\x00b c\x1cd")]
    got = [tuple(r) for r in simhash.near_duplicates(docs_of(rows)).collect()]
    same_as_plain(rows, got)
    assert simhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 9])
@pytest.mark.parametrize("chunk", [3, 4096])
def test_exact_links_for_any_chunk(spark, radius, chunk):
    """Clusters of fingerprints a few bits apart, so that chains and hot bands occur."""
    pick = np.random.default_rng(radius)
    base = pick.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in pick.integers(0, 64, pick.integers(1, 7)):
                x ^= 1 << int(bit)
            prints.add(x)
    shape = simhash.Shape(radius=radius, chunk=chunk, bundle=64)
    rows = [(bytearray(p.to_bytes(8, "big")), i, 1, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    classes = spark.createDataFrame(rows, "fp binary, doc_id long, copies long, node long")
    roots = {r.node: r.root for r in components(simhash.linked(classes, shape)).collect()}
    node = {p: n for (_, _, _, n), p in zip(rows, sorted(prints))}
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    groups = {}
    for p in prints:
        groups.setdefault(root(p), set()).add(node[p])
    want = {n: min(g) for g in groups.values() if len(g) > 1 for n in g}
    assert roots == want


def test_distances_of_bit_planes():
    pick = np.random.default_rng(3)
    raw = pick.integers(0, 256, (70, 32), dtype=np.uint8)
    raw[40] = raw[3]
    raw[41] = raw[3] ^ (pick.random((32,)) < 0.3).astype(np.uint8)
    bits = bitslice.bits_of(raw)
    planes = bitslice.planes_of(bits, np.arange(70), 2)
    rows, words = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(2), indexing="ij"))
    valid = np.where(words == 0, bitslice.FULL, np.uint64((1 << 6) - 1))
    for radius in (0, 5, 55, 120):
        found = {(int(a), int(b)): int(d) for part in bitslice.near(bits, planes, rows, words, valid, radius, slab=17) for a, b, d in zip(*part)}
        want = {(a, b): d for a in range(70) for b in range(70) if (d := int((bits[a] != bits[b]).sum())) <= radius}
        assert found == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (500, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {500: 400, 400: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similarity(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(docs_of):
    pick = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(4000)])
    rows, copies = [], set()
    for d in range(60):
        text = list(pick.choice(words, pick.integers(60, 400)))
        rows.append((d, " ".join(text)))
        for c in range(3):
            other = list(text)
            for at in pick.integers(0, len(text), max(1, len(text) // 120)):
                other[at] = "changed"
            rows.append((1000 + 10 * d + c, " ".join(other)))
            if similarity(rows[-1][1], " ".join(text)) >= 0.8:
                copies.add(1000 + 10 * d + c)
    rows += [(3, rows[8][1]), (2000, None), (2001, ""), (2002, " ")] + [(2000, None)]
    docs = docs_of(rows)
    out = near_copies.one_of_each(docs)
    kept = sorted(r.doc_id for r in out.collect())
    assert out.columns == docs.columns
    clean = {d for d in range(60)}
    assert set(kept) >= clean and 2000 in kept and not {2001, 2002} & set(kept) and len(kept) == len(set(kept))
    assert len(copies) > 100 and not copies & set(kept)


def test_near_copies_of_nothing(docs_of):
    assert near_copies.one_of_each(docs_of([])).count() == 0
