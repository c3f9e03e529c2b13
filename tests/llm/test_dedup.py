import hashlib
import random

import numpy as np
import pytest
import xxhash

from ferrovia.llm import near_copies, simhash, substring_dedup

DOCS = "doc_id long, text string, tag string, spans string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "s", "f") for r in rows], DOCS)


def words_of(text):
    return [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]


def brute_force(rows):
    starts = {}
    for doc_id, text in rows:
        w = words_of(text)
        for i in range(len(w) - 49):
            starts.setdefault(tuple(w[i : i + 50]), []).append(doc_id)
    for doc_id, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - 49):
            if any(d is not None and (doc_id is None or d < doc_id) for d in starts[tuple(w[i : i + 50])]):
                gone |= set(range(i, i + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["the", "of", "año", "x", "élan", "to", f"w{rng.randrange(400)}"]) for _ in range(n))
    shared, line = say(70), say(50)
    rows = [(k, f"{say(rng.randrange(80))} {shared if k % 3 == 0 else ''}\n{say(rng.randrange(60))}\t{line if k % 4 == 0 else ''} {say(20)}") for k in range(40)]
    rows += [(40, rows[7][1]), (41, rows[7][1]), (41, rows[7][1]), (42, shared + " " + shared), (None, line + " tail"), (None, line), (43, None), (44, ""), (45, " \n "), (46, say(49)), (47, "Ａ\x1cb\xa0c " * 60), (48, "Ａ\x1cb\xa0c " * 60), (-5, line)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, held, segment", [(1, 1 << 21, 1 << 18), (7, 40, 64)])
def test_windows_against_brute_force(spark, passages, monkeypatch, partitions, held, segment):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
    got = substring_dedup.remove_repeats(frame(spark, passages).repartition(partitions))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.drop("kept").collect()), key=key) == sorted(brute_force(passages), key=key)


def test_a_small_sketch_loses_nothing(spark, passages, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", 1 << 20)
    monkeypatch.setattr(substring_dedup, "_cells", lambda m, row, bits: (m >> np.uint64(61)))
    got = substring_dedup.remove_repeats(frame(spark, passages))
    assert sorted(r["n_removed"] for r in got.collect()) == sorted(r[2] for r in brute_force(passages))


def test_rows_without_repeats(spark, passages):
    kept = substring_dedup.without_repeats(frame(spark, passages))
    assert kept.columns == ["doc_id", "text", "tag", "spans", "fp"]
    by = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 40 not in by and by[46] == dict(passages)[46] and by[44] == ""
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_many_rows_without_an_id(spark):
    """Rows without an id are told apart by all of their text, not by a short hash of it."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    passage = say(55)
    rows = [(1, passage)] + [(None, f"{say(rng.randrange(40))} {passage if k % 5 == 0 else ''} {say(20)}") for k in range(300)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).drop("kept")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in brute_force(rows))


def test_repetitive_documents_send_few_rows(spark):
    """A window at equal distances is one row, whatever the number of its places."""
    line = " ".join(f"l{k}" for k in range(17))
    rows = [(k, f"{line} " * (400 + k)) for k in range(6)] + [(9, "word " * 5000)]
    docs = frame(spark, rows).select("doc_id", "text")
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("kept").collect()) == sorted(brute_force(rows))
    pos = np.array([0, 1, 2, 9, 12, 15, 4, 0, 7])
    first, step, n = substring_dedup._packed(pos, np.array([1, 0, 0, 0, 0, 0, 1, 1, 0], bool))
    assert sorted(p + s * k for p, s, m in zip(pos[first], step, n) for k in range(m)) == sorted(pos.tolist())
    assert len(first) < len(pos)


def test_columns_of_any_name(spark):
    rows = [(1, "a " * 60, 5, 7, "x"), (2, "a " * 60 + "b", 6, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long, tag long, spans string")
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], (2, "b", 6, 8, "y")]


def slow_fingerprint(text, shingle=4):
    w = [x for x in words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "a b c d", "Ä É x y z z z z z", "k " * 300, "İ K ſ a\xa0b c\x1cd e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def linked(fps, distance=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(fps):
        for j in range(i):
            if bin(x ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(fps))]


def near(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("large", [8192, 20])
def test_forest_joins_what_links_join(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(large)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({near(rng, rng.choice(seeds), rng.randrange(9)) for _ in range(150)})
    a, b = simhash.forest(np.array(fps, np.uint64), (1 << 64) - 1)
    want, root = linked(fps), list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in zip(a.tolist(), b.tolist()):
        assert bin(fps[x] ^ fps[y]).count("1") <= 4
        x, y = sorted((find(x), find(y)))
        root[y] = x
    assert [find(k) for k in range(len(fps))] == want


@pytest.mark.parametrize("small, blocks", [(24, 6), (2, 7)])
def test_links_against_all_pairs(spark, monkeypatch, small, blocks):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(blocks)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0]
    fps = sorted({near(rng, rng.choice(seeds), rng.randrange(8)) for _ in range(300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks).collect()
    place = {x: k for k, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for e in edges:
        a, b = sorted((find(place[e["a"]]), find(place[e["b"]])))
        root[b] = a
    assert [find(k) for k in range(len(fps))] == linked(fps)


def test_components_of_documents(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(900)]
    one, two = " ".join(base), " ".join(base[:450] + ["changed"] + base[451:])
    rows = [(7, one), (3, two), (5, one), (5, one), (None, two), (1, None), (2, ""), (9, " \n"), (4, "short text"), (6, "Short TEXT")]
    assert bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") <= 4
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (5, 3), (5, 3), (None, 3), (1, 1), (2, 1), (9, 1), (4, 4), (6, 4)], key=str)
    kept = simhash.without_near_duplicates(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]  # one of each, the row without an id is a copy
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def five_words(text):
    w = words_of(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_near_copies_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(9))
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 6, 30, 80, 140]))] for _ in range(12)]
    texts = [" ".join(x) for x in base]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(900)}"
        texts.append(" ".join(w) + (f" {line}" if rng.random() < 0.4 else ""))
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") > 4
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 20  # links that the distance of operator 7 doesn't have
    kept = near_copies.without_near_copies(frame(spark, list(enumerate(texts))).repartition(3))
    assert kept.columns == ["doc_id", "text", "tag", "spans", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert near_copies.without_near_copies(frame(spark, [])).count() == 0


def test_near_copies_go_by_row(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [(1, x), (1, y), (0, x), (0, x), (0, x.upper()), (None, x), (None, z), (None, z), (3, None), (None, "")]
    kept = near_copies.without_near_copies(frame(spark, rows).repartition(3)).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept), key=str) == sorted([(0, x), (1, y), (3, ""), (None, z)], key=str)


@pytest.mark.parametrize("large, blocks", [(8192, 6), (12, 6), (3, 8)])
def test_groups_are_dealt_again(spark, monkeypatch, large, blocks):
    """Fingerprints that share key bits by the hundred: the links are those of all pairs, however often they are dealt."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(blocks)
    low = [rng.getrandbits(30) for _ in range(300)]
    fps = sorted({near(rng, rng.choice(low) | 0xABCD << 48, rng.randrange(4)) for _ in range(500)})
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long"), 4, blocks).collect()
    at, root = {r[0]: k for k, r in enumerate(rows)}, list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        assert bin(fps[at[a]] ^ fps[at[b]]).count("1") <= 4
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    want = linked(fps)
    assert [find(k) for k in range(len(fps))] == want and len(set(want)) < len(fps)


def test_parity_fingerprints_never_lose_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 300)))
        for _ in range(5):
            keep = base[rng.random(len(base)) < rng.choice([1.0, 0.95, 0.9, 0.8])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(base) // 8)))))
    fp = near_copies.fingerprints(sets)
    far = near_copies.pivot_table(fp)
    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            apart = np.setxor1d(a, sets[j]).size
            assert near_copies._apart(fp[[i]], fp[j])[0] <= apart and np.abs(far[i] - far[j]).max() <= apart
            if 5 * np.intersect1d(a, sets[j]).size >= 4 * np.union1d(a, sets[j]).size:
                links.add((j, i))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for pairs in (links, near_copies.forest(sets)):
        root = list(range(len(sets)))
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = [find(k) for k in range(len(sets))]
        want = got if pairs is links else want
    assert got == want and len(set(got)) < len(sets)


def test_rows_of_clashing_names(spark):
    rows = [(1, "a b c d e f", 5, 6, "k"), (1, "other words here at all", 7, 8, "k"), (2, "a b c d e f", 9, 9, "k"), (None, None, 0, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, key int, place string")
    for without in (near_copies.without_near_copies, simhash.without_near_duplicates):
        kept = without(docs)
        assert kept.columns == docs.columns and sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[3]]))
