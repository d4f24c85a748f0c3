import hashlib
import random
import re
import time

from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from walksieve.llm import pii, queries

from .conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_finds_all_base_spans(spark, given):
    docs = {r.doc_id: r.text for r in given("documents").collect()}
    rows = queries.op10_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        base = plain_base(docs[r.doc_id])
        some += len(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(base_text(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("other")] == base_text(base).split(",") * bool(base)
        for s in spans:
            kind, a, b = s.split(":")
            assert int(a) < int(b) <= len(docs[r.doc_id])
            if kind == "other":
                assert not any(x < int(b) and int(a) < y for x, _, y in base)
    assert some > 20


ODD = [None, "", "é😀 a@b.c-x@d.e", "x@y a@b.c_d@e.f.g..h", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.255", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111 7",
       "+1 (988) 555-2485.", "+123456789 +1 2", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a" * 60_000 + "@", "1" * 60_000, "1." * 30_000, "a@" + "b." * 30_000 + "c",
       "+1" + " " * 60_000 + "2", "@ @@ a@@b.c", "0 0 0 0 0 0 0 0 0 0 0 0", "x+y@z.w +49 30 123456-7", "1.1.1.1 " * 2000, "%@a.b", "٣٤ 12"]


def test_odd_texts(docs_of):
    docs = docs_of([*enumerate(ODD), (6, ODD[6]), (None, "a@b.c")])
    got = sorted((str(r.doc_id), r.base_sha256) for r in pii.digest(pii.personal_data(docs)).collect())
    want = [(str(i), hashlib.sha256(base_text(plain_base(t)).encode()).hexdigest()) for i, t in [*enumerate(ODD), (6, ODD[6]), (None, "a@b.c")]]
    assert got == sorted(want)
    assert pii.digest(pii.personal_data(docs_of([]))).count() == 0
    assert [r.spans for r in pii.digest(pii.personal_data(docs_of([(1, "none")]))).collect()] == [""]


def test_very_many_matches_in_one_text(docs_of):
    """A log of 40 000 words with digits, every eighth an address: minutes if the work grew with the square."""
    words = [f"1.2.3.{i % 250}" if i % 8 == 0 else f"x{i}é" for i in range(40_000)]
    text = " ".join(words)
    begun = time.monotonic()
    row = pii.digest(pii.personal_data(docs_of([(1, text)]))).first()
    assert time.monotonic() - begun < 60
    base = plain_base(text)
    assert row.n_ip == 5000 and row.base_sha256 == hashlib.sha256(base_text(base).encode()).hexdigest()
    for s in row.spans.split(","):
        kind, a, b = s.split(":")
        assert kind in ("ip", "other") and text[int(a):int(b)] == text[int(a):].split(" ")[0].rstrip("é") and text[int(a) - 1:int(a)] in ("", " ")


def test_base_overlap_is_found_by_halving(spark):
    """Against every span in turn, for none to nine spans."""
    rng = random.Random(3)
    rows = []
    for n in range(10):
        ends = sorted(rng.sample(range(60), 2 * n))
        spans = [(ends[2 * i], ends[2 * i + 1]) for i in range(n)]
        rows += [(spans, (a, a + w), any(x < a + w and a < y for x, y in spans)) for a in range(0, 60, 3) for w in (1, 2, 7)]
    df = spark.createDataFrame(rows, "spans array<struct<start: bigint, end: bigint>>, c struct<start: bigint, end: bigint>, want boolean")
    assert df.filter(pii._overlaps(F.col("spans"), F.col("c")) != F.col("want")).count() == 0


@settings(max_examples=8, deadline=None)
@any_of(st.lists(st.text(alphabet="0129.@ab-+() é😀_%", max_size=60), min_size=80, max_size=120))
def test_patterns_match_like_the_plain_ones(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["k"], s["end"]) for s in r.base] for r in pii.candidates(df).select("doc_id", "base").collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def test_votes_decide_what_is_added(docs_of):
    own = [(i, f"text {chr(97 + i % 26)} password=a8f3e9{i:04d}bc77d1 end") for i in range(60)]
    plain = [(100 + i, f"see page {i % 90} of the book") for i in range(60)]
    mails = [(200 + i, f"write to user{i}@mail{i}.example.com now") for i in range(60)]
    rows = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs_of(own + plain + mails))).collect()}
    assert all(rows[i].startswith("other:7:") for i, _ in own) and all(rows[i] == "" for i, _ in plain)
    assert all(rows[i].startswith("email") and "other" not in rows[i] for i, _ in mails)


def test_reliable_labelers_are_told_from_unreliable_ones():
    counts = {"yy-": 300, "nn-": 600, "yyn": 40, "nny": 60, "--y": 30, "yn-": 10}
    prior, chances, belief = pii.reliabilities(counts)
    assert belief["yy-"] > 0.9 and belief["nn-"] < 0.1 and belief["yyn"] > 0.5 and 0.2 < prior < 0.6
