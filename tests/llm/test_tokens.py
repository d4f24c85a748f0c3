import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from walksieve.llm import queries, repair, separators, tokens
from walksieve.llm.tokens import encoder
from walksieve.session import scratch_path

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "a", "  a b", "a  b", "a \n b", "don't stop 's", "x\n\ny", " é ñ", "日本 語 a", "a\tb c", "<|endoftext|> a b<|endoftext|>", "a.b, c", "Iñ, x.y.",
       "ab.,", "1 2  3\r\n4", "a\x00b \x00", "!! !\n!", "word " * 30_000, "a" * 50_000, "foo!\n'll x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@any_of(st.lists(st.text(alphabet="ab.,' \n\té!0<|> 　", max_size=30), max_size=4))
def test_cut_texts_encode_like_whole_ones(texts):
    library = Tokenizer.from_file(PATH)
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder(PATH).encode(texts)] == [ids_of(library, t) for t in texts]


def test_a_known_part_takes_tens_of_bytes():
    """They used to be Python strings and bytes, some hundreds of bytes a part."""
    coder = tokens.Encoder(PATH, False)
    words = [f"part{i:x}" for i in range(20_000)]
    coder.encode([" ".join(words), "\n".join(words[:500])])
    held = [x.nbytes for x in vars(coder).values() if isinstance(x, np.ndarray) and x is not coder.spaced and x is not coder.feed]
    assert len(coder.used) >= 20_499 and sum(held) < 100 * len(coder.used)


@pytest.mark.parametrize("numbers, kept", [(1 << 63, 5), (8, 400_000), (1, 5)])
def test_parts_that_share_a_number_and_are_forgotten(monkeypatch, library, numbers, kept):
    plain, coder, rng = tokens._hashes, tokens.Encoder(PATH, False), np.random.default_rng(kept)
    monkeypatch.setattr(tokens, "_hashes", lambda data, at: plain(data, at) % np.uint64(numbers))
    monkeypatch.setattr(tokens, "KEPT_PARTS", kept)
    for _ in range(60):
        texts = ["".join(rng.choice(list("ab.,  \n"), n)) for n in rng.integers(0, 40, 5)]
        assert [np.frombuffer(raw, "<u4").tolist() for raw in coder.encode(texts)] == [ids_of(library, t) for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_pieces_of_a_column(kind):
    texts = ["ab", None, "", "ñ" * 40, "c", "d" * 9, None]
    got = list(tokens.pieces(pa.array(["x", *texts], kind).slice(1), 10))
    assert [t for _, _, some in got for t in some] == texts and len(got) > 2
    assert [(a, b) for a, b, _ in got] == list(zip([0, *[b for _, b, _ in got]], [b for _, b, _ in got]))
    assert list(tokens.pieces(pa.array([], kind))) == [(0, 0, [])]


def expected(library, rows):
    at, out = 0, []
    for i, text in rows:
        ids = np.array([*ids_of(library, text), 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_reads_back_what_was_encoded(spark, given, library):
    rows = sorted((r.doc_id, r.text) for r in given("documents").collect())
    got = sorted(tuple(r) for r in queries.op2_repair_shards(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(library, rows)


def test_odd_texts_and_repeated_rows(spark, docs_of, library):
    path = scratch_path(spark, "odd-shards")
    repair.write_shards(docs_of([*enumerate(ODD), (3, "a b")]), path, PATH)
    got = sorted(tuple(r) for r in repair.read_shards(spark, path).collect())
    assert len(got) == len(ODD) + 1
    starts = sorted((r[1], r[2]) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
    want = {(r[0], r[2], r[3]) for r in expected(library, [*enumerate(ODD), (3, "a b")])}
    assert {(r[0], r[2], r[3]) for r in got} == want


def test_no_documents(spark, docs_of):
    path = scratch_path(spark, "no-shards")
    repair.write_shards(docs_of([]), path, PATH)
    assert repair.read_shards(spark, path).count() == 0
    path = scratch_path(spark, "no-tokens")
    separators.write_flat(docs_of([]), path, RANKS, public_tokenizers.PATTERN, 50256)
    assert separators.token_counts(spark.read.parquet(path), 50256).count() == 0


@settings(max_examples=60, deadline=None)
@any_of(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_any_range_is_expanded_from_the_rules(ids, a, b):
    shard = repair.Shard(repair.pack([1, None], [np.array(ids, np.uint32), np.array([0], np.uint32)], 1 << 17))
    whole = [*ids, 0]
    lo, hi = sorted((min(a, len(whole)), min(b, len(whole))))
    assert shard.ids(lo, hi).tolist() == whole[lo:hi]
    assert len(shard.ends) <= len(whole) and int(shard.ends[-1]) == len(whole)


def test_rules_shorten_repetitive_ids():
    ids = np.tile(np.array([5, 6, 7, 8, 9, 5, 6, 2], np.uint32), 500)
    seq, rules, lengths = repair.compress(ids, 1 << 17)
    assert len(seq) <= len(ids) / 16 and np.array_equal(repair.expand(seq, rules, 1 << 17), ids)
    assert all(len(repair.expand(np.array([(1 << 17) + k], np.uint32), rules, 1 << 17)) == n for k, n in enumerate(lengths))


@pytest.mark.parametrize("lift", [0, 1 << 62])
def test_frequent_pairs_by_count_then_by_pair(lift):
    """Also where a pair and its place do not fit one number."""
    rng, lift = np.random.default_rng(0), np.uint64(lift)
    keys = rng.integers(0, 40, 500).astype(np.uint64) + lift
    pairs, at = repair.frequent_pairs(keys, 12)
    counted = {k: int((keys == k).sum()) for k in set(keys.tolist())}
    wanted = sorted((k for k, n in counted.items() if n >= 12), key=lambda k: (-counted[k], k))
    assert pairs.tolist() == wanted and 0 < len(wanted) < len(counted)
    assert at.tolist() == [wanted.index(k) if k in wanted else len(wanted) for k in keys.tolist()]


def test_rare_pairs_are_not_sorted(monkeypatch):
    keys = np.append(np.arange(1 << 17), np.zeros(50)).astype(np.uint64)
    sizes, plain = [], np.sort
    monkeypatch.setattr(repair.np, "sort", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    pairs, at = repair.frequent_pairs(keys, 6)
    assert pairs.tolist() == [0] and (at == 0).sum() == 51 and sum(sizes) < len(keys) / 8
    pairs, at = repair.frequent_pairs(keys[:9], 6)
    assert len(pairs) == 0 and at.tolist() == [0] * 9


def test_all_documents_of_a_shard_at_once(monkeypatch):
    """Whole reads expand each rule once, not each document from its own range."""
    rng = np.random.default_rng(1)
    texts = [np.append(rng.choice([5, 6, 7], n), 0).astype(np.uint32) for n in (300, 0, 7, 1200, 1)]
    shard = repair.Shard(repair.pack([1, 2, None, 4, 4], texts, 1 << 17))
    calls, plain = [], repair.expand
    monkeypatch.setattr(repair, "expand", lambda *a: calls.append(1) or plain(*a))
    assert len(shard.rules) and [d.tolist() for d in shard.documents()] == [t.tolist() for t in texts]
    assert len(calls) == 1


def test_separator_query_counts_every_document(spark, given, library):
    got = {r.doc_id: r.n_tokens for r in queries.op6_separator_scan(spark, SF).collect()}
    library.encode_special_tokens = True
    assert got == {r.doc_id: len(ids_of(library, r.text)) for r in given("documents").collect()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_documents_across_any_block_border(spark, size):
    pick = np.random.default_rng(size)
    files = {f: np.where(pick.random(60) < 0.3, 9, 1).astype("<u4") for f in range(3)}
    files[3], files[4] = np.array([9, 9, 9], "<u4"), np.array([1, 1, 1, 1], "<u4")
    rows = [(f, k, bytearray(ids[k * size:(k + 1) * size].tobytes())) for f, ids in files.items() for k in range(-(-len(ids) // size))]
    got = sorted(tuple(r) for r in separators.scan(spark.createDataFrame(rows, "file int, block long, payload binary").repartition(4), 9).collect())
    want = []
    for f, ids in files.items():
        start = place = 0
        for end in [*np.flatnonzero(ids == 9), None]:
            if end is not None:
                want.append((f, place, start, int(end) - start, True))
                start, place = int(end) + 1, place + 1
            elif start < len(ids):
                want.append((f, place, start, len(ids) - start, False))
    assert got == sorted(want)


def test_flat_files_of_odd_texts(spark, docs_of):
    path = scratch_path(spark, "odd-flat")
    separators.write_flat(docs_of([*enumerate(ODD), (3, "a b"), (None, "x")]), path, RANKS, public_tokenizers.PATTERN, 50256, block_ids=64)
    got = sorted((str(r.doc_id), r.n_tokens) for r in separators.token_counts(spark.read.parquet(path), 50256).collect())
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    assert got == sorted((str(i), len(ids_of(library, t))) for i, t in [*enumerate(ODD), (3, "a b"), (None, "x")])
