import hashlib
import random
import zlib

import numpy as np
import pytest

from ferrovia.llm import motion_jpeg, mtree

VECTORS = "vec_id long, embedding array<float>, dim int, v string"


def brute_force(rows, k=5):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    for q, a in fine:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            yield from ((q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1))


@pytest.mark.parametrize("page, rows", [(96, 2048), (4, 50)])
def test_top_k_against_brute_force(spark, monkeypatch, page, rows):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "LEAST_ROWS", rows)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 3)
    rng = random.Random(page)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    table = [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)]) for k in range(400)]
    table += [(400 + k, [0.5] * 6) for k in range(60)] + [(500, [0.0] * 6), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (650, []), (700, None), (750, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (850, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors = mtree.usable_vectors(spark.createDataFrame([(*r, 1, "x") for r in table], VECTORS))
    got = mtree.top_k(vectors.where("vec_id % 50 = 0"), vectors)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_force(table))


def test_large_components_stay_exact(spark):
    table = [(0, [3.0e9, 1.0]), (1, [1.5, 1.0]), (2, [1.5, 1.0]), (3, [-2.0, 4.0])]
    vectors = mtree.usable_vectors(spark.createDataFrame([(*r, 1, "x") for r in table], VECTORS))
    assert sorted(tuple(r) for r in mtree.top_k(vectors.where("vec_id = 0"), vectors).collect()) == sorted(brute_force(table))


def test_scores_beyond_64_bits(spark):
    """They count as the largest 64-bit integer; components that leave 64 bits take no part."""
    table = [(0, [1e13, 1.0]), (1, [1e13, 2.0]), (2, [-1e13, 2.0]), (3, [1.5, 2.0]), (4, [1e38, 1.0]), (50, [2.0, 3e38])]
    vectors = mtree.usable_vectors(spark.createDataFrame([(*r, 1, "x") for r in table], VECTORS))
    got = [tuple(r) for r in mtree.top_k(vectors.where("vec_id % 50 = 0"), vectors).orderBy("rank").collect()]
    near = int(np.floor(256 * float(np.float32(1e13)))) * 384 + 256 * 512
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 3, near), (0, 3, 2, -(1 << 63))]


def test_one_large_vector_among_many(spark, monkeypatch):
    monkeypatch.setattr(mtree, "LEAST_ROWS", 64)
    rng = random.Random(5)
    table = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)] + [(1000, [4e12, -3e12, 1.0, 2.0]), (1050, [-4e12, 3e12, 1.0, 2.0])]
    vectors = mtree.usable_vectors(spark.createDataFrame([(*r, 1, "x") for r in table], VECTORS))
    got = mtree.top_k(vectors.where("vec_id % 50 = 0"), vectors)
    clipped = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in brute_force(table)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(clipped)


def test_clustered_vectors_skip_pages_and_cells(spark, monkeypatch):
    monkeypatch.setattr(mtree, "LEAST_ROWS", 200)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(0, 1, (40, 16)), 100, axis=0) + rng.normal(0, 0.02, (4000, 16))
    v = np.floor(256 * x).astype(np.int64)
    pages = mtree.build_tree(np.arange(4000), v)
    leaves, read = sum("ids" in p for p in pages), []
    for q in range(0, 4000, 50):
        found = mtree.search_tree(pages, v[q], q, read=read)
        order = np.lexsort((np.arange(4000), -(v @ v[q])))
        assert [i for _, i in found] == [i for i in order.tolist() if i != q][:5]
    assert len(read) < 0.25 * leaves * 80
    vectors = spark.createDataFrame([(k, r.tolist(), 16) for k, r in enumerate(v)], "vec_id long, v array<long>, dim int")
    forest = mtree.Forest(vectors)
    asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v", "dim", "0 AS block", "cast(null as long) AS least")
    floors = {int(q): int(np.sort(np.delete(v @ v[q], q))[-5]) for q in range(0, 4000, 50)}
    known = spark.createDataFrame(list(floors.items()), "query_id long, least long")
    assert forest.routed(asked, False).count() == 80 and len(forest.balls.value[16][0]) == 12
    assert forest.routed(asked.drop("least").join(known, "query_id"), True).count() < 0.5 * 80 * 11


def test_no_vectors(spark):
    vectors = mtree.usable_vectors(spark.createDataFrame([], VECTORS))
    assert mtree.top_k(vectors, vectors).count() == 0


def samples(n=5):
    x = np.random.default_rng(0).integers(0, 256, (n, motion_jpeg.FRAME), dtype=np.uint8)
    x[1], x[2] = 255, 0
    return x


def test_frames_round_trip():
    x = samples()
    frames = motion_jpeg.encode_frames(x)
    assert (motion_jpeg.decode_frames(frames) == x).all()
    assert all((motion_jpeg.decode_jpeg(f).ravel() == row).all() for f, row in zip(frames, x))


def test_other_huffman_tables():
    x = samples()
    frame = motion_jpeg.encode_frames(x[:1])[0]
    # the same code, its table behind an application segment
    other = frame[:2] + motion_jpeg._segment(0xE0, b"AVI1\0") + frame[2:]
    assert (motion_jpeg.decode_frames([other, frame]) == x[0]).all()


def baseline_jpeg(planes, sampling, quantizer, every=0, tables=True, size=None):
    """A baseline JPEG, written the plain way; ``planes`` hold whole units."""
    codes = {}
    for key, (counts, symbols) in motion_jpeg._USUAL_TABLES.items():
        code, k, codes[key] = 0, 0, {}
        for length, n in enumerate(bytes.fromhex(counts), 1):
            for symbol in bytes.fromhex(symbols)[k : k + n]:
                codes[key][symbol] = f"{code:0{length}b}"
                code += 1
            k, code = k + n, code << 1

    def extra(v):
        n = abs(v).bit_length()
        return n, f"{v if v >= 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def block_bits(block, dc, ac, before):
        c = motion_jpeg._COSINES
        flat = np.rint((c @ (block.astype(float) - 128) @ c.T).ravel() / quantizer).astype(int)[motion_jpeg._ZIGZAG]
        n, bits = extra(int(flat[0]) - before)
        out, run = [codes[0, dc][n], bits], 0
        for v in flat[1:].tolist():
            if not v:
                run += 1
                continue
            while run > 15:
                out.append(codes[1, ac][0xF0])
                run -= 16
            n, bits = extra(v)
            out += [codes[1, ac][run << 4 | n], bits]
            run = 0
        return "".join([*out, codes[1, ac][0] if run else ""]), int(flat[0])

    h, v = sampling[0]
    down, across = planes[0].shape[0] // (8 * v), planes[0].shape[1] // (8 * h)
    parts, bits, before = [], [], [0] * len(planes)
    for unit in range(down * across):
        if every and unit and unit % every == 0:
            parts.append("".join(bits))
            bits, before = [], [0] * len(planes)
        for k, (plane, (n, m)) in enumerate(zip(planes, sampling)):
            for y in range(m):
                for x in range(n):
                    a, b = 8 * (unit // across * m + y), 8 * (unit % across * n + x)
                    some, before[k] = block_bits(plane[a : a + 8, b : b + 8], min(k, 1), min(k, 1), before[k])
                    bits.append(some)
    parts.append("".join(bits))
    scan = b""
    for k, bits in enumerate(parts):
        bits += "1" * (-len(bits) % 8)
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    height, width = size or planes[0].shape
    seg = motion_jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"AVI1\0\0\0\0") + seg(0xDB, b"\0" + bytes([quantizer] * 64))
    if tables:
        head += b"".join(seg(0xC4, bytes([c << 4 | k]) + bytes.fromhex(n) + bytes.fromhex(s)) for (c, k), (n, s) in motion_jpeg._USUAL_TABLES.items())
    if every:
        head += seg(0xDD, every.to_bytes(2))
    frame = bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([len(planes)]) + b"".join(bytes([k + 1, n << 4 | m, 0]) for k, (n, m) in enumerate(sampling))
    scans = bytes([len(planes)]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(planes))) + bytes([0, 63, 0])
    return head + seg(0xC0, frame) + seg(0xDA, scans) + scan + b"\xff\xd9"


def picture(rng, height, width):
    smooth = np.cumsum(np.cumsum(rng.normal(0, 1, (height, width)), axis=0), axis=1)
    return np.clip(128 + 60 * smooth / np.abs(smooth).max() + rng.normal(0, 6, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("every, tables", [(0, True), (3, False)])
def test_baseline_frames(every, tables):
    rng = np.random.default_rng(2)
    grey, fine = picture(rng, 24, 40), picture(rng, 32, 48)
    got = motion_jpeg.decode_jpeg(baseline_jpeg([grey], [(1, 1)], 2, every, tables, (21, 37)))
    assert got.shape == (21, 37) and np.abs(got.astype(int) - grey[:21, :37]).max() <= 6
    colour = [fine, picture(rng, 16, 24), picture(rng, 16, 24)]
    got = motion_jpeg.decode_jpeg(baseline_jpeg(colour, [(2, 2), (1, 1), (1, 1)], 2, every, tables))
    assert got.shape == fine.shape and np.abs(got.astype(int) - fine).max() <= 6
    assert sorted(motion_jpeg._ZIGZAG.tolist()) == list(range(64)) and motion_jpeg._ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    for counts, symbols in motion_jpeg._USUAL_TABLES.values():
        assert sum(bytes.fromhex(counts)) == len(set(bytes.fromhex(symbols))) == len(bytes.fromhex(symbols))


def test_foreign_and_broken_files(spark):
    """Shots of baseline frames, and a row with its error for each file that can't be read."""
    rng = np.random.default_rng(3)
    dark, light = ([np.clip(rng.normal(m, 20, (16, 24)), 0, 255).astype(np.uint8) for _ in range(6)] for m in (40, 200))
    avi = motion_jpeg.write_avi([baseline_jpeg([x], [(1, 1)], 4) for x in dark + light + dark])
    files = [(1, avi), (2, None), (3, b""), (4, b"RIFF0000WAVE"), (5, avi[:300]), (6, avi.replace(b"\xff\xc0", b"\xff\xc2")), (7, avi[:-12] + b"\xff" * 12), (8, motion_jpeg._avi_of("x"))]
    media = spark.createDataFrame([(*f, "e") for f in files], "doc_id long, media binary, error string")
    got = {r["doc_id"]: r for r in motion_jpeg.describe_media(media).collect()}
    assert got[1]["feature"].startswith("18/3/") and got[1]["payload_bytes"] == 18 * 16 * 24
    assert [(c["first_frame"], c["frames"], c["end_s"]) for c in got[1]["clips"]] == [(0, 6, 0.24), (6, 6, 0.48), (12, 6, 0.72)]
    assert all(got[k]["error"] and got[k]["payload_sha256"] is None for k in (2, 3, 4, 5, 6, 7)) and not got[8]["error"]
    rows = motion_jpeg.clips(media).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 1, 2, 3, 4, 5, 6, 7, 8] and all((r["clip"] is None) == (r["error"] is not None) for r in rows)


def test_avi_index():
    frames = motion_jpeg.encode_frames(samples())
    avi = motion_jpeg.write_avi(frames)
    places, rate = motion_jpeg.index_avi(avi)
    assert [avi[a : a + n] for a, n in places] == frames and rate == motion_jpeg.FPS
    with pytest.raises(ValueError):
        motion_jpeg.index_avi(b"RIFF0000WAVE")


def test_cuts_follow_the_histogram():
    rng = np.random.default_rng(1)
    dark, light = (rng.integers(a, a + 60, (30, motion_jpeg.FRAME), dtype=np.uint8) for a in (0, 180))
    assert motion_jpeg.find_cuts(motion_jpeg.histograms(np.concatenate([dark, light, dark]))) == [30, 60]
    assert motion_jpeg.find_cuts(motion_jpeg.histograms(dark)) == []
    assert motion_jpeg.find_cuts(motion_jpeg.histograms(dark[:1])) == []


def test_media_of_texts(spark, monkeypatch):
    monkeypatch.setattr(motion_jpeg, "STEP", 3)
    texts = [(1, "a"), (2, None), (3, ""), (4, "é" * 288), (5, "x" * 5000), (6, "x" * 5000), (None, "\x00\x7f" * 300), (1, "a")]
    docs = spark.createDataFrame([(*t, "m") for t in texts], "doc_id long, text string, media string")
    media = motion_jpeg.store_media(docs)
    got = sorted(motion_jpeg.describe_media(media).collect(), key=lambda r: str(r["doc_id"]))
    for r, (doc_id, text) in zip(got, sorted(texts, key=lambda t: str(t[0]))):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    five, six = (next(r for r in got if r["doc_id"] == k) for k in (5, 6))
    assert five["media_sha256"] == six["media_sha256"] and five["feature"] == six["feature"]
    clips = motion_jpeg.clips(media).where("doc_id = 5").orderBy("clip").collect()
    assert sum(c["frames"] for c in clips) == 9 and clips[0]["start_s"] == 0 and clips[-1]["end_s"] == 9 / 25
    assert motion_jpeg.describe_media(motion_jpeg.store_media(docs.limit(0))).count() == 0
