import zlib

import numpy as np

from walksieve.llm import language_id as L
from walksieve.llm import queries

from .conftest import SF


def test_held_out_rows_are_classified_right(spark, given):
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    docs = {r.doc_id: r for r in given("documents").collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    asked = [i for i, r in rows.items() if r.held_out and docs[i].lang]
    right = sum(rows[i].lang_pred == docs[i].lang for i in asked)
    assert right >= 0.97 * len(asked)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"} for r in rows.values())


def test_labels_sources_and_held_out_rows_do_not_matter(docs_of):
    base = [(i, ("der und die " if i % 2 else "the and of ") * 9, "de" if i % 2 else "en") for i in range(40)]
    other = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i, t, lang in base]
    one, two = (L.fit(docs_of(rows)) for rows in (base, other))
    assert one.languages == two.languages == ["de", "en"]
    assert all(np.array_equal(a, b) for a, b in zip(one.filters, two.filters))


def test_cases_without_a_language(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "12 34 !?"), (None, "the and of"), (5, "the and of " * 90_000), (5, "the and of"), (7, "and", None), (8, "½ ² ①")])
    net = L.fit(docs_of([(i, "the and of", "en") for i in range(20)]))
    got = sorted(((r.doc_id, r.lang_pred, r.held_out) for r in L.languages(docs, net).collect()), key=str)
    assert [g[1] for g in got if g[0] in (1, 2, 3, 8)] == ["und"] * 4
    assert [g[1] for g in got if g[0] in (None, 5, 7)] == ["en"] * 4
    assert not any(held for i, _, held in got if i is None)
    assert L.only_known_languages(docs, net).columns == docs.columns and L.only_known_languages(docs, net).count() == 4


def test_empty_tables(docs_of):
    empty = docs_of([])
    net = L.fit(empty)
    assert L.languages(empty, net).count() == 0
    assert [tuple(r)[2:] for r in L.languages(docs_of([(1, "a")]), net).collect()] == [("und", 0.0)]
