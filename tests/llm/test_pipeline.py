"""The pipeline over the smallest tables, each stage against brute force on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from walksieve.session import written

from .conftest import SF
from .test_leaks_and_urls import plain_leaks
from .test_simhash import similarity


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return [([tuple(r) for r in d.collect()], d.columns) for d in out]


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "temperature_mixing", "bounded_ring_sharding"]
    first = stages[0][1]
    assert all(columns == first for _, columns in stages[:-1])
    assert stages[-1][1] == [*first, "shard", "slot"]


def test_known_languages_stay(stages):
    (before, _), (after, _) = stages[0], stages[1]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert all(not any(c.isalpha() for c in r[1] or "") for r in before if r[0] in gone)


def test_one_document_of_each_group(stages):
    (before, _), (after, _) = stages[1], stages[2]
    kept = {r[0] for r in after}
    assert len(kept) == len(after)
    texts = {r[0]: r[1] for r in before}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sizes = {d: len(t.split()) for d, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and 0.75 <= sizes[a] / max(1, sizes[b]) <= 1.35 and similarity(texts[a], texts[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(set)
    for d in texts:
        groups[root(d)].add(d)
    assert all(len(g & kept) >= 1 for g in groups.values())
    assert all(g <= kept for g in groups.values() if len(g) == 1)
    assert all(g & kept == {min(g)} for g in groups.values())
    assert any(len(g) > 1 for g in groups.values())


def test_documents_with_items_go(spark, stages):
    (before, _), (after, _) = stages[2], stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for _, d, _, _ in plain_leaks([r[:2] for r in before], items)}
    assert sorted(r[0] for r in after) == sorted(r[0] for r in before if r[0] not in leaked)


def test_no_document_is_lost_in_the_mixture(stages):
    (before, _), (after, _) = stages[3], stages[4]
    copies = Counter(r[0] for r in after)
    assert copies.keys() == {r[0] for r in before} and max(copies.values()) <= 3
    assert {r[:2] for r in after} == {r[:2] for r in before}


def test_shards_are_even_and_gapless(stages):
    (before, _), (after, _) = stages[4], stages[5]
    assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
    slots = defaultdict(list)
    for r in after:
        slots[r[-2]].append(r[-1])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_same_rows(spark, stages):
    assert Counter(tuple(r)[0] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r[0] for r in stages[-1][0])
