"""Media columns: AVI files of motion JPEG, written and read back, and their shots.

A file written here holds one video stream of 24 x 24 grey frames. Each frame is a JPEG of its own, of the lossless
sequential process (SOF3, 8-bit samples, each predicted from its left neighbour), so every sample comes
back as it was. Its Huffman table gives the category of ``s`` extra bits a code of ``9 - s`` bits:
the code is complete but for the reserved all-ones word, and every sample takes nine bits, which
whole arrays can code and decode: a file is an eighth larger than its payload.

Files of others are read too: frames of any size, of the baseline and extended sequential processes with
Huffman codes (their brightness, by the inverse cosine transform; restart intervals; the usual tables where a
frame has none, as motion JPEG allows) and lossless grey ones with predictor 1.

Reading starts from the bytes alone: the RIFF tree is walked, the index (``idx1``) gives the place
of each frame, frames are decoded, and shots are cut where the histogram of a frame differs from the
one before by more than the mean and ``SPREAD`` deviations of the differences in the last ``MEMORY``
frames. A clip is a run of frames with its times.

A file that can't be read stops nothing: its row has nulls and says why in ``error``; so does a null file's.

A text is stored as its UTF-8 bytes and bytes 255 up to a positive multiple of a frame, so an empty or
null text is one frame of 255. Equal texts give equal bytes. Rows may repeat and ``doc_id`` may be null.
An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored. A file must
stay below 4 GB, the limit of RIFF; its writer raises beyond.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import stash, table

SIDE, FPS = 24, 25
FRAME = SIDE * SIDE
BINS, MEMORY, SPREAD, LEAST = 16, 12, 3.0, 0.25
#: Frames coded or decoded at a time.
STEP = 4096


def _huffman() -> tuple[list[int], list[int], list[int]]:
    """Codes by category 0..8, their lengths, and the categories in order of length."""
    order = list(range(8, -1, -1))
    codes, code = [0] * 9, 0
    for s in order:
        codes[s] = code
        code = (code + 1) << 1
    return codes, [9 - s for s in range(9)], order


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit code of each difference + 255, and the difference of each nine-bit code."""
    codes, _, _ = _huffman()
    code_of, value_of = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = codes[s] << s | (d if d >= 0 else d + (1 << s) - 1)
        code_of[d + 255], value_of[code] = code, d
    return code_of, value_of


_CODE_OF, _VALUE_OF = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head() -> bytes:
    _, _, order = _huffman()
    table_of = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(order)
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    scan = bytes([1, 1, 0, 1, 0, 0])  # predictor 1
    return b"\xff\xd8" + _segment(0xC4, table_of) + _segment(0xC3, frame) + _segment(0xDA, scan)


_HEAD, _TAIL = _frame_head(), b"\xff\xd9"


def _predict(x: np.ndarray) -> np.ndarray:
    """Differences of frames (n, SIDE, SIDE): from the left, in the first column from above, first of all from 128."""
    d = np.empty(x.shape, np.int16)
    d[:, :, 1:] = x[:, :, 1:].astype(np.int16) - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0].astype(np.int16) - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0].astype(np.int16) - 128
    return d


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each frame of FRAME samples."""
    code = _CODE_OF[_predict(samples.reshape(-1, SIDE, SIDE)) + 255].reshape(len(samples), FRAME // 8, 8)
    packed = np.empty((len(samples), FRAME // 8, 9), np.uint8)
    for k in range(9):  # eight codes of nine bits are nine bytes
        high = (code[:, :, k - 1] << (8 - k)) & 0xFF if k else 0
        packed[:, :, k] = high | (code[:, :, k] >> (k + 1)) if k < 8 else high
    data = packed.reshape(len(samples), -1).tobytes()
    size = FRAME * 9 // 8
    return [_HEAD + data[a : a + size].replace(b"\xff", b"\xff\x00") + _TAIL for a in range(0, len(data), size)]


def _rebuild(d: np.ndarray, height: int = SIDE, width: int = SIDE) -> np.ndarray:
    d = d.reshape(-1, height, width).astype(np.int32)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8).reshape(len(d), height * width)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of each frame, a row each; frames of one file have one size."""
    size, ours = FRAME * 9 // 8, [f.startswith(_HEAD) for f in frames]
    out: list = [None] * len(frames)
    at = [k for k, x in enumerate(ours) if x]
    if at:
        data = b"".join(frames[k][len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for k in at)
        if len(data) != len(at) * size:
            raise ValueError("a frame's scan has the wrong length")
        packed = np.frombuffer(data, np.uint8).reshape(len(at), FRAME // 8, 9).astype(np.uint16)
        code = np.empty((len(at), FRAME // 8, 8), np.uint16)
        for k in range(8):
            code[:, :, k] = (packed[:, :, k] & ((1 << (8 - k)) - 1)) << (k + 1) | packed[:, :, k + 1] >> (7 - k)
        rebuilt = _rebuild(_VALUE_OF[code])
        if len(at) == len(frames):
            return rebuilt
        for k, row in zip(at, rebuilt, strict=True):
            out[k] = row
    for k, x in enumerate(ours):
        if not x:
            out[k] = decode_jpeg(frames[k]).ravel()
    if len({len(x) for x in out}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack(out)


#: The Huffman tables of ITU-T T.81, Annex K.3, which frames of motion JPEG may leave out: codes of
#: each length from 1 to 16, then the symbols. By class (DC, AC) and number (brightness, colour).
_USUAL_TABLES = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    (1, 1): (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}

#: Place of each coefficient in its block, row by row: along the diagonals, back and forth.
_ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))])
_COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may follow: length of the code that they begin with, times 256, and its symbol; 0 for none."""
    out, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    if len(out) != 65536:
        raise ValueError("a Huffman table has too many codes")
    return out


class _Bits:
    """The bits of a scan's interval; beyond its end they are ones, as the standard pads."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            piece = self.data[self.at : self.at + 8]
            if not piece:
                if self.at > len(self.data) + 64:
                    raise ValueError("a scan ends too early")
                piece = b"\xff" * 8
            self.at += len(piece)
            self.held, self.n = self.held << (8 * len(piece)) | int.from_bytes(piece), self.n + 8 * len(piece)
        return self.held >> (self.n - n)

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def symbol(self, table_of: list[int]) -> int:
        found = table_of[self.peek(16)]
        if not found:
            raise ValueError("no such Huffman code")
        self.skip(found >> 8)
        return found & 0xFF

    def signed(self, n: int) -> int:
        if not n:
            return 0
        x = self.peek(n)
        self.skip(n)
        return x if x >> (n - 1) else x - (1 << n) + 1


def decode_jpeg(jpeg: bytes) -> np.ndarray:
    """The brightness (rows, columns) of a sequential or a lossless grey JPEG."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    tables = {k: (bytes.fromhex(c), bytes.fromhex(v)) for k, (c, v) in _USUAL_TABLES.items()}
    quantizers, frame, process, every, at = {}, None, 0, 0, 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, (length,) = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)
        if marker == 0xFF:  # fill
            at += 1
            continue
        body, at = jpeg[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantizers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * bool(wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker in (0xC0, 0xC1, 0xC3):
            process = marker
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("samples of eight bits only")
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither a sequential nor a lossless frame")
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("a scan without a frame")
    scans = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(jpeg, at)
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", jpeg[at : stop.start() if stop else len(jpeg)])]
    if process == 0xC3:
        if len(frame) != 1 or body[1 + 2 * body[0]] != 1 or every:
            raise ValueError("a lossless frame that is not grey, or of another predictor")
        table_of, bits = _lookup(*tables[0, scans[frame[0][0]] >> 4]), _Bits(parts[0])
        return _rebuild(np.array([bits.signed(bits.symbol(table_of)) for _ in range(height * width)]), height, width).reshape(height, width)
    if set(scans) != {c[0] for c in frame}:
        raise ValueError("a scan for each component")
    return _brightness(frame, scans, tables, quantizers, parts, every, height, width)


def _brightness(frame: list, scans: dict, tables: dict, quantizers: dict, parts: list[bytes], every: int, height: int, width: int) -> np.ndarray:
    """The first component of an interleaved scan, through the inverse cosine transform."""
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    tall, wide = max(c[2] for c in frame), max(c[1] for c in frame)
    across, down = -(-width // (8 * wide)), -(-height // (8 * tall))
    every = every or across * down
    _, h, v, q = frame[0]
    if h != wide or v != tall:
        raise ValueError("brightness is sampled less finely than colour")
    blocks = np.zeros((down * v, across * h, 64), np.int64)
    coders = [(k, c[1], c[2], _lookup(*tables[0, scans[c[0]] >> 4]), _lookup(*tables[1, scans[c[0]] & 15])) for k, c in enumerate(frame)]
    for part, data in enumerate(parts):
        bits, before = _Bits(data), [0] * len(frame)
        for unit in range(part * every, min((part + 1) * every, across * down)):
            for k, n_across, n_down, dc, ac in coders:
                for y in range(n_down):
                    for x in range(n_across):
                        before[k] += bits.signed(bits.symbol(dc))
                        block = blocks[unit // across * v + y, unit % across * h + x] if k == 0 else None
                        if block is not None:
                            block[0] = before[k]
                        at = 1
                        while at < 64:
                            symbol = bits.symbol(ac)
                            run, size = symbol >> 4, symbol & 15
                            if not size and run != 15:
                                break
                            at += run
                            value = bits.signed(size)
                            if at > 63:
                                raise ValueError("a block has too many coefficients")
                            if block is not None:
                                block[at] = value
                            at += 1
    flat = np.zeros_like(blocks)
    flat[:, :, _ZIGZAG] = blocks * quantizers[q]
    samples = _COSINES.T @ flat.reshape(*flat.shape[:2], 8, 8) @ _COSINES + 128
    whole = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * down * v, 8 * across * h)
    return whole[:height, :width]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF file of the frames, with its index."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    sizes = np.array([len(f) for f in frames], np.int64)
    steps = 8 + sizes + sizes % 2
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1] = struct.unpack("<I", b"00dc")[0], 0x10
    index[:, 2], index[:, 3] = 4 + np.cumsum(steps) - steps, sizes
    movie = b"movi" + b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2) for f in frames)
    body = b"AVI " + lists + _chunk(b"LIST", movie) + _chunk(b"idx1", index.tobytes())
    if len(body) >= 1 << 32:
        raise ValueError("an AVI file holds less than 4 GB")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def index_avi(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    """(place, size) of each frame by the file's index, and the frames a second."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index, rate = 0, b"", float(FPS)
    todo = [(12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]))]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            name, (size,) = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)
            if name == b"LIST":
                if avi[at + 8 : at + 12] == b"movi":
                    movie = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"strh" and avi[at + 8 : at + 12] == b"vids":
                scale, ticks = struct.unpack_from("<II", avi, at + 28)
                rate = ticks / scale
            elif name == b"idx1":
                index = avi[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    rows = np.frombuffer(index[: len(index) // 16 * 16], "<u4").reshape(-1, 4).astype(np.int64)
    rows = rows[(rows[:, 0] & 0xFFFF0000) == struct.unpack("<I", b"\0\0dc")[0]]
    if not len(rows):
        raise ValueError("no frame in the index")
    first = int(rows[0, 2])  # some writers count from the file's start
    base = 0 if avi[first : first + 4] == struct.pack("<I", int(rows[0, 0])) and first >= movie else movie
    return [(base + a + 8, n) for a, n in rows[:, 2:].tolist()], rate


def histograms(samples: np.ndarray) -> np.ndarray:
    """Share of each bin in each frame."""
    bins = (samples >> 4).astype(np.int64) + BINS * np.arange(len(samples))[:, None]
    return np.bincount(bins.ravel(), minlength=BINS * len(samples)).reshape(-1, BINS) / samples.shape[1]


def find_cuts(shares: np.ndarray) -> list[int]:
    """Frames that begin a shot, but for the first: by an adaptive threshold on histogram differences."""
    if len(shares) < 2:
        return []
    apart = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (apart, apart * apart))
    k = np.arange(len(apart))
    low = np.maximum(0, k - MEMORY)
    n = np.maximum(1, k - low)
    mean = (sums[k] - sums[low]) / n
    spread = np.sqrt(np.maximum(0, (squares[k] - squares[low]) / n - mean * mean))
    cuts = np.where(k > 0, apart > np.maximum(LEAST, mean + SPREAD * spread), apart > 2 * LEAST)
    return (np.flatnonzero(cuts) + 1).tolist()


def _avi_of(text: str | None) -> bytes:
    payload = (text or "").encode()
    payload += b"\xff" * (-len(payload) % FRAME or (0 if payload else FRAME))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    return write_avi([f for k in range(0, len(samples), STEP) for f in encode_frames(samples[k : k + STEP])])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                media = [_avi_of(t.as_py()) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def _decoded(avi: bytes):
    """Samples of a file, some frames at a time."""
    places, _ = index_avi(avi)
    for k in range(0, len(places), STEP):
        yield decode_frames([avi[a : a + n] for a, n in places[k : k + STEP]])


#: What a file that can't be read may raise.
_BROKEN = (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError)


def _read(avi: bytes | None, of):
    """What ``of`` makes of a file, and why it couldn't."""
    if avi is None:
        return None, "no file"
    try:
        return of(avi), None
    except _BROKEN as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def _shots(cuts: list[int], frames: int, rate: float) -> list[tuple[int, int, float, float]]:
    """First frame, frames, start and end in seconds of each shot."""
    return [(a, b - a, a / rate, b / rate) for a, b in zip([0, *cuts], [*cuts, frames], strict=True)]


_CLIP_TYPES = (("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string()))
_CLIPS = "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, error string"


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of each file: clip, first_frame, frames, start_s, end_s; one with its ``error`` for a file that can't be read."""

    def of(avi: bytes) -> list:
        places, rate = index_avi(avi)
        return _shots(find_cuts(np.concatenate([histograms(s) for s in _decoded(avi)])), len(places), rate)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, avi in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                shots, error = _read(avi.as_py(), of)
                rows += [(doc_id, None, None, None, None, None, error)] if error else [(doc_id, k, *shot, None) for k, shot in enumerate(shots)]
            columns = zip(zip(*rows, strict=True), _CLIP_TYPES, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in columns], [n for n, _ in _CLIP_TYPES])

    return media.select("doc_id", "media").mapInArrow(run, _CLIPS)


def describe_media(media: DataFrame) -> DataFrame:
    """What each file holds, from its bytes alone: payload, checksums, a feature of its shots, and the shots.

    ``feature`` is ``frames/shots/first cuts' checksum``: the number of frames and of shots, and the
    CRC-32 of the frames that begin a shot. ``clips`` has a struct for each shot, as :func:`clips` has rows.
    """
    clip = pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "shots": pa.int64(), "duration_s": pa.float64(), "clips": pa.list_(clip), "error": pa.string()}

    def of(avi: bytes) -> tuple:
        digest, shares, size, padding, tail = hashlib.sha256(), [], 0, 0, b""
        places, rate = index_avi(avi)
        for samples in _decoded(avi):
            raw = samples.tobytes()
            digest.update(raw)
            shares.append(histograms(samples))
            size += len(raw)
            bare = len(raw.rstrip(b"\xff"))  # UTF-8 has no byte 255
            padding = len(raw) - bare if bare else padding + len(raw)
            tail = (tail + raw)[-32:]
        cuts = find_cuts(np.concatenate(shares))
        feature = f"{len(places)}/{len(cuts) + 1}/{zlib.crc32(np.array(cuts, '<u4').tobytes()):08x}"
        shots = [dict(zip(("first_frame", "frames", "start_s", "end_s"), x, strict=True)) for x in _shots(cuts, len(places), rate)]
        return size - padding, size, digest.hexdigest(), zlib.crc32(tail), len(avi), hashlib.sha256(avi).hexdigest(), feature, len(cuts) + 1, len(places) / rate, shots

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, avi in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                avi = avi.as_py()
                found, error = _read(avi, of)
                if error:
                    found = (None, None, None, None, *((len(avi), hashlib.sha256(avi).hexdigest()) if avi is not None else (None, None)), None, None, None, None)
                rows.append((doc_id, *found, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shots long, duration_s double, clips array<struct<first_frame: long, frames: long, start_s: double, end_s: double>>, error string")


def op5_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(stash(store_media(table(spark, sf_dir, "documents")), "media", 7))
