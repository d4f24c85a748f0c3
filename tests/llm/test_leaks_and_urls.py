import numpy as np
import pytest

from walksieve.llm import leaks, queries, url_filter
from walksieve.llm.url_filter import Rule

from .conftest import SF


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_leaks(docs, items, least=0.8):
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, u in items:
            asked = shingles(u)
            if asked and len(own & asked) >= least * len(asked):
                out.append((i, d, len(own & asked), len(asked)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, given):
    got = sorted((tuple(r)[:4] for r in queries.op9_leaks(spark, SF).collect()), key=str)
    want = plain_leaks([(r.doc_id, r.text) for r in given("documents").collect()], [(r.item_id, r.text) for r in given("benchmark").collect()])
    assert want and got == want


def test_items_of_all_sizes_in_long_documents(spark, docs_of):
    pick = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{i}" for i in pick.integers(0, 30_000, n))
    items = [(k, word(n)) for k, n in enumerate([3, 5, 6, 17, 20, 21, 33, 37, 64, 69, 150, 400, 1000, 5000])]
    items += [(90, None), (91, ""), (92, "a b"), (2, items[2][1]), (None, word(30))]
    docs = [(100 + k, f"{word(3000)} {t} {word(200)}") for k, (_, t) in enumerate(items) if t]
    docs += [(200 + k, f"{word(int(pick.integers(0, 90)))} {' '.join((t or '').split()[:-2])}") for k, (_, t) in enumerate(items)]
    docs += [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, word(200_000)), (6, items[7][1].upper()), (6, items[7][1].upper())]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, shared string")
    got = sorted((tuple(r)[:4] for r in leaks.leaks(docs_of(docs), table).collect()), key=str)
    assert got == plain_leaks(docs, items)
    kept = leaks.without_leaks(docs_of(docs), table)
    leaked = {d for _, d, _, _ in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_a_passage_in_pieces_is_found(spark, docs_of):
    item = " ".join(f"k{i}" for i in range(60)).split()
    filler = " ".join(f"f{i}" for i in range(700))
    doc = f"{' '.join(item[:30])} {filler} {' '.join(item[26:])}"
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [tuple(r)[:2] for r in leaks.leaks(docs_of([(5, doc)]), table).collect()] == [(1, 5)]


def test_item_blocks_give_the_same(spark, docs_of, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BYTES", 100)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(30)]
    docs = [(i, f"before {t} after") for i, t in items] + [(99, "nothing here at all to see")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in leaks.leaks(docs_of(docs), table).collect()) == [(i, i) for i in range(30)]
    assert [r.doc_id for r in leaks.without_leaks(docs_of(docs), table).collect()] == [99]


def test_no_items_or_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks.leaks(docs_of([(1, "a")]), none).count() == 0 and leaks.leaks(docs_of([]), some).count() == 0
    assert leaks.without_leaks(docs_of([(1, "a")]), none).count() == 1


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [r for r in rules for h, p in [r.parts] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [None, "", "no scheme", "http://", "http://com/en/1", "HTTP://WWW.Example.COM/en/7x", "https://example.com/en/6", "x://a.example.com?q=/en/", "x://com",
        "ftp://a://b/c#d", "http://net/de/", "http://a.example.net/de/8/1?x", "http://a.xnet/de/", "http://İÄ.org/es/ö", "x://org/es", "http://org/es/\nq", "http://h" + "a" * 20_000 + "/p"]


def test_query_applies_rules_first(spark, given):
    rows = {r.page_id: r for r in queries.op5_url_filter(spark, SF).collect()}
    pages = {r.page_id: r.url for r in given("pages").collect()}
    assert rows.keys() == pages.keys()
    for i, url in pages.items():
        r, rule = rows[i], plain_rule(*plain_parts(url), queries.RULES)
        assert (r.host, r.path) == plain_parts(url) and r.rule == (rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.unwanted >= 0.5 else "allow")


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(spark.createDataFrame(url_filter.LABELLED, "url string, unwanted int"))


def test_odd_urls(spark, model):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, verdict string")
    for r in url_filter.judged(pages, queries.RULES, model).collect():
        url = [*URLS, URLS[4]][r.page_id]
        rule = plain_rule(*plain_parts(url), queries.RULES)
        assert (r.host, r.path, r.rule) == (*plain_parts(url), rule.text if rule else None) and 0 <= r.unwanted <= 1
    assert url_filter.judged(pages.limit(0), [Rule("block", "a/")], model).count() == 0


def test_unseen_urls_are_judged_by_their_grams(model):
    bad = ["mycasino-slots.test", "cheap-pills4u.test", "free-bets.example.net", "adult-x.example.org", "spam-farm.example.com", "ads-track.example.net"]
    good = ["weather.example.org", "tionsh.example.net", "library.test", "m.thther.example.org", "news.test", "docs.test"]
    chance = model.chances([h.encode() for h in bad + good], [b"/en/123"] * 12)
    assert (chance[:6] >= 0.5).all() and (chance[6:] < 0.5).all()
    assert url_filter.train([]).chances([b"x"], [b"/"])[0] < 0.5
