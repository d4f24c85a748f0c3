"""Near copies against brute force: whole groups go, and nothing else does."""

import numpy as np
import pytest

from walksieve.llm import near_copies, simhash

from .test_simhash import similarity


def expected(rows):
    """The smallest doc_id of each component of the pairs at 0.8 or more."""
    root = {d: d for d, _ in rows}

    def of(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = [(d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) for d, w in ((d, t.split()) for d, t in rows)]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 10 * len(x & y) >= 8 * len(x | y):
                root[max(of(a), of(b))] = min(of(a), of(b))
    return {d for d in root if of(d) == d}


def kept(docs_of, rows):
    out = [r.doc_id for r in near_copies.one_of_each(docs_of(rows)).select("doc_id").collect()]
    assert len(out) == len(set(out))
    return set(out)


def star(pick, first, n, edits, length=204):
    """A text and `n` copies of it, each with words replaced far from each other."""
    text = [f"a{first}x{i}" for i in range(length)]
    rows = [(first + n, " ".join(text))]
    for c in range(n):
        own = list(text)
        for place in 5 + 10 * pick.choice((length - 10) // 10, edits, replace=False):
            own[place] = f"e{first}x{c}x{place}"
        rows.append((first + c, " ".join(own)))
    return rows


def test_copies_of_one_original_all_go(docs_of):
    # copies at 0.82 of the original and at about 0.67 of each other
    rows = star(np.random.default_rng(1), 0, 150, 4)
    assert similarity(rows[0][1], rows[1][1]) >= 0.8 > similarity(rows[1][1], rows[2][1])
    assert kept(docs_of, rows) == expected(rows) == {0}


@pytest.mark.parametrize("stars", [0, 2])
def test_open_links_of_joined_classes_are_followed(docs_of, monkeypatch, stars):
    pick = np.random.default_rng(2)
    rows = star(pick, 0, 60, 3) + [(100 + d, t) for d, t in star(pick, 0, 30, 4)[1:]] + star(pick, 1000, 40, 8)
    monkeypatch.setattr(near_copies, "STARS", stars)
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    monkeypatch.setattr(near_copies, "BUNDLE", 256)
    assert kept(docs_of, rows) == expected(rows)


def test_short_texts_at_the_threshold_go(docs_of):
    # 4 and 5 shingles: exactly 0.8
    rows = []
    for d in range(0, 300, 2):
        words = [f"w{d}x{i}" for i in range(9)]
        rows += [(d, " ".join(words[:8])), (d + 1, " ".join(words))]
    assert kept(docs_of, rows) == expected(rows) == set(range(0, 300, 2))


def test_short_texts_below_the_threshold_stay(docs_of):
    # 8 shingles each, 7 of them shared: 7 / 9
    rows = []
    for d in range(0, 1600, 2):
        words = [f"w{d}x{i}" for i in range(13)]
        rows += [(d, " ".join(words[:12])), (d + 1, " ".join(words[1:]))]
    assert kept(docs_of, rows) == set(range(1600))


def test_long_texts_that_share_much_are_told_about_once(docs_of):
    """Texts of shared passages, all under 0.8: their pairs share many shingles and are few rows."""
    pick = np.random.default_rng(7)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(12)]
    rows = []
    for d in range(40):
        own = [passages[k] for k in pick.choice(12, 4, replace=False)]
        rows.append((d, " ".join([*own, *(f"d{d}x{i}" for i in range(120))])))
    rows += [(100 + d, rows[d][1] + " and more") for d in range(5)]
    assert kept(docs_of, rows) == expected(rows) == set(range(40))


def test_folded_counts_never_rule_out_a_copy():
    pick = np.random.default_rng(8)
    for n in (1, 5, 100, 511, 512, 700, 3000):
        s = np.unique(pick.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate((s[:len(s) - len(s) // 9], pick.integers(0, 2**63, len(s) // 9).astype(np.uint64))))
        shared = len(np.intersect1d(s, other))
        x, y = (np.frombuffer(near_copies._cells(v), "<u2")[None, :] for v in (s, other))
        if 9 * shared >= 4 * (len(s) + len(other)):
            assert near_copies._can_be_alike(x, y, np.array([len(s) + len(other)])).all()
