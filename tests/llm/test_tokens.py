import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrovia.llm import packing, simple8b, token_files
from ferrovia.llm.tokenizing import ChunkEncoder, default_path

EDGES = ["", None, " ", "\n", "a", "  a b", "a  b", "a\n\nb", "a\n b", "a \nb", "foo\n", "foo ", "\tx y", "x\ty z", "é à\xa0b", "\0a b", "\1", "\2", "a \2 b", "\1b c", "don't it's 'q' we've", "日本語 テスト", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|>", "x <|endoftext|>\n<|endoftext|> y", "x1 2y 3", ".. a", 'w" ,x', "a\x1c b", "word... (x) ***", "Ǆ ʰx", "x" * 5000]
DOCS = "doc_id long, text string, extra string, ids_crc32 string"


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(default_path())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def encoded(texts):
    parts = list(ChunkEncoder(default_path()).encode(pa.array(texts, pa.string())))
    ids, lengths = (np.concatenate(x) for x in zip(*parts))
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_edges_encode_as_the_library_does(plain):
    assert encoded(EDGES) == [plain(t) for t in EDGES]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'. \n\t é1, #\r"), max_size=30), min_size=1, max_size=8))
def test_any_white_space(texts):
    tok = Tokenizer.from_file(default_path())
    assert encoded(texts) == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_long_texts_are_cut_at_spaces(plain, monkeypatch):
    monkeypatch.setattr("ferrovia.llm.tokenizing.PART_CHARS", 50)
    text = "some  words here, " * 40
    assert encoded([text]) == [plain(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 50_000), st.sampled_from([(1 << 20) - 2, (1 << 20) - 1, 1 << 20, (1 << 32) - 1])), max_size=900))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint32)
    words, first, side = simple8b.pack(x)
    assert (simple8b.unpack(words, first, side, len(x)) == x).all()
    page = simple8b.write_page(x, np.array([len(x), 0]), [7, None])
    back, lengths, keys = simple8b.read_page(page)
    assert (back == x).all() and lengths.tolist() == [len(x), 0] and keys == [7, None]


def test_runs_of_zeros_pack_into_a_word():
    assert len(simple8b.pack(np.zeros(240, np.uint32))[0]) == 1


def expected(rows, plain):
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(text)
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file(spark, plain, monkeypatch):
    monkeypatch.setattr(token_files, "PAGE_IDS", 64)
    rows = [(9 - k if k % 7 else None, t) for k, t in enumerate(EDGES)] + [(3, "same"), (3, "same"), (3, "other")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    pages = token_files.write_token_pages(docs, default_path())
    got = [tuple(r) for r in token_files.read_token_pages(pages).collect()]
    assert sorted(got, key=lambda r: r[1]) == list(expected(rows, plain))
    assert token_files.read_token_pages(token_files.write_token_pages(docs.limit(0), default_path())).count() == 0


def check_packing(rows, want_ids, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and 0 < p["length"] <= capacity
            at += p["length"]
        assert at <= capacity
    got = sorted((r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for ids in want_ids:
        cuts = list(range(len(ids), 0, -capacity))
        want += [(b - max(0, b - capacity), zlib.crc32(np.array(ids[max(0, b - capacity) : b], "<u4").tobytes())) for b in cuts]
    assert got == sorted(want)
    return len(by)


def test_packing(spark, plain):
    rows = [(k, t) for k, t in enumerate(EDGES)] + [(None, "a b c"), (5, "same text"), (5, "same text"), (50, "long " * 400)]
    packed = packing.pack(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS), capacity=16, keep_ids=True).cache()
    n = check_packing(packed.collect(), [plain(t) for _, t in rows], 16)
    assert n <= sum(len(plain(t)) for _, t in rows) / 16 * 1.1 + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit opens, a document at a time."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                gaps.append(capacity - length)
            else:
                gaps.remove(fit)
                gaps.append(fit - length)
    return len(gaps)


def check_places(places, counts, capacity):
    """Every document has one place, no sequence overflows or has a hole; the number of sequences."""
    used, ranks = {}, {length: [] for length in counts}
    for length, low, high, each, first, at in places:
        ranks[length] += range(low, high)
        for r in range(high - low):
            used.setdefault(first + r // each, []).append((at + r % each * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for spots in used.values():
        end = 0
        for a, n in sorted(spots):
            assert a == end
            end += n
        assert end <= capacity
    assert sorted(used) == list(range(len(used)))
    return len(used)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 60), min_size=1))
def test_a_sweep_packs_like_best_fit_decreasing(counts):
    places, left, _ = packing.sweep([(k, 0, n) for k, n in counts.items()], [], 20, 0)
    assert not left and check_places(places, counts, 20) == best_fit_decreasing(counts, 20)


@pytest.mark.parametrize("seed, capacity", [(0, 1024), (1, 1024), (2, 1024), (3, 64)])
def test_supersteps_pack_like_best_fit_decreasing(spark, seed, capacity):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(capacity, 1 + rng.exponential((capacity / 3, capacity / 12, capacity / 40, capacity / 2)[seed], 1500).astype(int))
    counts = {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True))}
    found = packing.find_places(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity)
    n = check_places([tuple(r) for r in found.collect()], counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    assert -(-int(sizes.sum()) // capacity) <= n <= best + max(1, best // 200)
    assert found.sparkSession.createDataFrame([], "length long, n long").transform(packing.find_places).count() == 0
