"""Removal of passages of 50 words that an earlier document has too.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window that covers it
also starts, word for word, in a document with a smaller ``doc_id``; windows are judged on the
input. Three passes:

1. *Count-min prefilter.* Windows are represented by minimizers: the least hash among the 25-word
   shingles inside a window, so that equal windows have equal minimizers and neighbours mostly
   share theirs. Each partition counts, for every document, its distinct minimizers in a count-min
   sketch whose counters stop at two; the partitions' sketches are merged in a tree. The sketch
   overestimates, so a window whose minimizer is counted once occurs in one document only.
2. *Exact grouping* of just the windows estimated repeated, by 128-bit hashes of their words: two
   rolling sums over two unrelated hashes of each word. A map
   task first settles the copies that it holds itself: only those of its smallest document go on
   to the shuffle, the places at equal distances as one row, so a passage that a third of all
   documents share, or a document that repeats one line, sends one row a task.
3. The spans that go are gathered by document and cut out of its text.

The sketch's width follows the corpus up to ``MAX_CELLS``; beyond that its memory stays the
same and it only rejects less, losing nothing.

Null and short texts have no window. A null ``doc_id`` counts as larger than all others. Rows of one
``doc_id``, and rows without one, never remove each other's words; a row is known by its ``doc_id``
and a 64-bit hash of its text, so equal rows share their spans and get the same result. An empty
table gives no rows. Columns other than ``doc_id`` and ``text`` are passed through or ignored,
whatever their names: they travel as one column.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import kept, release, table

WINDOW, SHINGLE = 50, 25
ROWS, BLOCK_BITS, MIN_CELLS, MAX_CELLS = 2, 20, 1 << 20, 1 << 29
#: Candidate windows that a map task holds before it settles them; partial sketches merged at a time;
#: windows of a text that are hashed at a time.
HELD, FAN_IN, SEGMENT = 1 << 21, 64, 1 << 18

_LAST = np.iinfo(np.int64).max  # in place of a null doc_id
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_ROW_MULTIPLIERS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the two bases and of their inverses, modulo 2**64, as far as any text needed them."""

    def __init__(self):
        self.up = self.down = np.ones((2, 1), np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.shape[1] < n:
            inverse = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)
            size = max(n, 2 * self.up.shape[1])
            self.up, self.down = (np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(b[:, None], size, 1)], axis=1), axis=1) for b in (_BASES, inverse))
        return self.up[:, :n], self.down[:, :n]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: at the six ASCII spaces alone


class Windows:
    """Hashes of all windows of at least ``WINDOW`` words."""

    def __init__(self, words: list[bytes]):
        import xxhash

        self.words = words
        self.up, self.down = kept("powers", _Powers).of(len(words))
        self.sums = [self._summed(xxhash.xxh3_64_intdigest, 0)]

    def _summed(self, digest, k: int) -> np.ndarray:
        h = np.fromiter(map(digest, self.words), np.uint64, len(self.words))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[k])])

    def _rolled(self, k: int, size: int, at: np.ndarray | slice) -> np.ndarray:
        s = self.sums[k]
        return (s[size:][at] - s[:-size][at]) * self.down[k][: len(s) - size][at]

    def minimizers(self) -> np.ndarray:
        low = _mix(self._rolled(0, SHINGLE, slice(None)))
        span, have = WINDOW - SHINGLE + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        if len(self.sums) == 1:
            self.sums.append(self._summed(xxhash.xxh64_intdigest, 1))
        return self._rolled(0, WINDOW, at), self._rolled(1, WINDOW, at)


def segments(words: list[bytes]):
    """(first window, hashes) of pieces of a text that share no window and together have all."""
    for at in range(0, len(words) - WINDOW + 1, SEGMENT):
        yield at, Windows(words[at : at + SEGMENT + WINDOW - 1])


def _cells(minimizers: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (minimizers * _ROW_MULTIPLIERS[row]) >> np.uint64(64 - bits)


def _to_bytes(cells: np.ndarray) -> bytes:
    """Cells of a block, which are sorted: a list where they are few, else a bitmap."""
    if 32 * len(cells) < 1 << BLOCK_BITS:
        return b"L" + cells.astype("<u4").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[cells] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def _to_bits(data: bytes) -> np.ndarray:
    if data[:1] == b"B":
        return np.frombuffer(data, np.uint8, offset=1)
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[np.frombuffer(data, "<u4", offset=1)] = 1
    return np.packbits(bits, bitorder="little")


_SKETCH = "sketch_row int, block int, part int, once binary, twice binary"


def partition_sketches(docs: DataFrame, bits: int) -> DataFrame:
    """Of each partition and block of cells: the cells counted at least once, and at least twice."""

    def sketch(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def rows():
            all_of = np.concatenate(held)
            for row in range(ROWS):
                cells, n = np.unique(_cells(all_of, row, bits), return_counts=True)
                block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
                inner = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
                found, start = np.unique(block, return_index=True)
                for b, i, j in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(cells)], strict=True):
                    yield row, b, part, _to_bytes(inner[i:j]), _to_bytes(inner[i:j][n[i:j] > 1])

        def batch():
            nonlocal held, size
            columns = zip(*rows(), strict=True)
            held, size = [], 0
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["sketch_row", "block", "part", "once", "twice"])

        for texts in batches:
            for text in texts.column("text"):
                if len(words := split_words(text.as_py())) >= WINDOW:
                    held.append(np.unique(np.concatenate([np.unique(w.minimizers()) for _, w in segments(words)])))
                    size += len(held[-1])
                    if size > 4 * HELD:
                        yield batch()
        if held:
            yield batch()

    return docs.select("text").mapInArrow(sketch, _SKETCH)


def merge_sketches(sketches: DataFrame, parts: int) -> DataFrame:
    """One row for each block, merged ``FAN_IN`` at a time. Counters stop at two."""

    def merge(pdf):
        once, twice = np.zeros(1 << BLOCK_BITS - 3, np.uint8), np.zeros(1 << BLOCK_BITS - 3, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a = _to_bits(a)
            twice |= _to_bits(b) | (once & a)
            once |= a
        first = pdf.iloc[:1].copy()
        first["once"], first["twice"] = [b"B" + once.tobytes()], [b"B" + twice.tobytes()]
        return first

    while True:
        parts = ceil(parts / FAN_IN)
        sketches = sketches.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        sketches = sketches.groupBy("sketch_row", "block", "part").applyInPandas(merge, _SKETCH)
        if parts <= 1:
            return sketches


def _repeated_cells(docs: DataFrame, bits: int) -> np.ndarray:
    """The merged sketch, as bits: row by row, whether a cell counts two or more. At most ROWS * MAX_CELLS bits."""
    merged = merge_sketches(partition_sketches(docs, bits), docs.rdd.getNumPartitions())
    seen = np.zeros((ROWS, 1 << bits - 3), np.uint8)
    size = 1 << BLOCK_BITS - 3
    for r in merged.select("sketch_row", "block", "twice").toLocalIterator():
        seen[r["sketch_row"], r["block"] * size : (r["block"] + 1) * size] = _to_bits(bytes(r["twice"]))
    return seen


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a run of equal (a, b) starts."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


#: Windows of a row: ``n`` of them at ``pos``, ``pos + step`` and so on, minus ``n`` if a task has settled that they go.
_FOUND = "h1 long, h2 long, doc long, tag long, at long, n int"


def _packed(pos: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that start a run of equally distant places, the runs' steps and lengths; ``new`` marks the first row of a group."""
    apart = np.diff(pos, prepend=pos[:1])
    start = new.copy()
    start[2:] |= ~new[1:-1] & (apart[2:] != apart[1:-1])
    first = np.flatnonzero(start)
    n = np.diff(np.append(first, len(pos)))
    step = np.where(n > 1, apart[np.minimum(first + 1, len(pos) - 1)], 1) if len(pos) else n
    return first, step, n


def _candidates(docs: DataFrame, seen, bits: int) -> DataFrame:
    """Windows estimated repeated that the shuffle has to settle, and spans that a task has settled."""

    def find(batches):
        held, doc_of, tag_of, size = [], [], [], 0

        def batch():
            nonlocal held, doc_of, tag_of, size
            h1, h2, row, pos = map(np.concatenate, zip(*held, strict=True))
            docs_, tags = np.array(doc_of, np.int64), np.array(tag_of, np.int64)
            held, doc_of, tag_of, size = [], [], [], 0
            order = np.lexsort((h2, h1))
            h1, h2, row, pos = h1[order], h2[order], row[order], pos[order]
            doc = docs_[row]
            start = _runs(h1, h2)
            least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(h1))))
            out = doc > least
            columns = []
            for mine, keys in ((~out, (pos, row, h2, h1)), (out, (pos, row))):
                order = np.lexsort([k[mine] for k in keys])
                a, b, r, p = (x[mine][order] for x in (h1, h2, row, pos))
                new = np.ones(len(p), bool)
                if mine is out:
                    new[1:] = r[1:] != r[:-1]
                else:
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1])
                first, step, n = _packed(p, new)
                if mine is out:
                    a, b = _mix(docs_[r].view(np.uint64)), np.zeros(len(p), np.uint64)
                    n = -n
                columns.append((a[first].view(np.int64), b[first].view(np.int64), docs_[r[first]], tags[r[first]], p[first].astype(np.int64) | step.astype(np.int64) << 32, n.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["h1", "h2", "doc", "tag", "at", "n"])

        sketch = seen.value
        for rows in batches:
            for doc, tag, text in zip(rows.column("doc").to_pylist(), rows.column("tag").to_pylist(), rows.column("text"), strict=True):
                if len(words := split_words(text.as_py())) < WINDOW:
                    continue
                for at, windows in segments(words):
                    low = windows.minimizers()
                    hit = np.arange(len(low))
                    for row in range(ROWS):
                        cell = _cells(low[hit], row, bits)
                        hit = hit[(sketch[row][(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    if hit.size:
                        held.append((*windows.hashes(hit), np.full(len(hit), len(doc_of), np.int32), (hit + at).astype(np.int32)))
                        doc_of.append(doc)
                        tag_of.append(tag)
                        size += len(hit)
                        if size >= HELD:
                            yield batch()
        if held:
            yield batch()
        release()

    return docs.select("doc", "tag", "text").mapInArrow(find, _FOUND)


def _settle(found: DataFrame) -> DataFrame:
    """(doc, tag, at, n): places of windows that a smaller document has."""

    def settle(batches):
        last = None  # (h1, h2, smallest doc) of the run that may go on
        for rows in batches:
            h1, h2, doc, tag, at, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if not len(h1):
                continue
            start = _runs(h1, h2)
            least = doc[start].copy()  # rows come in order of doc
            if last and (h1[0], h2[0]) == last[:2]:
                least[0] = last[2]
            last = (h1[-1], h2[-1], least[-1])
            out = (doc > np.repeat(least, np.diff(np.append(start, len(h1))))) | (n < 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc, tag, at, np.abs(n))], ["doc", "tag", "at", "n"])

    settled = F.col("n") < 0
    return found.repartition("h1").sortWithinPartitions(settled, "h1", "h2", "doc").mapInArrow(settle, "doc long, tag long, at long, n int")


def _row_key() -> tuple[F.Column, F.Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))), F.xxhash64("text")


def mark_repeats(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``) and ``spans``: windows (at, n) that go, as :data:`_FOUND` has them; null if none."""
    spark = docs.sparkSession
    doc, tag = _row_key()
    plain = docs.select(doc.alias("doc"), tag.alias("tag"), "text")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 6 * 2 / (WINDOW - SHINGLE + 2)  # minimizers, at six bytes a word
    bits = max(int(log2(MIN_CELLS)), min(int(log2(MAX_CELLS)), ceil(log2(max(1, 10 * expected)))))
    seen = spark.sparkContext.broadcast(_repeated_cells(plain, bits))
    spans = _settle(_candidates(plain, seen, bits)).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), tag.alias("tag"))
    return rows.join(spans, ["doc", "tag"], "left").select("row", "spans")


def keep_mask(n_words: int, spans: list | None) -> np.ndarray:
    """Which of a text's words stay."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        pos, step, n = s["at"] & 0xFFFFFFFF, s["at"] >> 32, s["n"]
        starts = np.array([pos]) if step <= WINDOW else pos + step * np.arange(n)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW + (step * (n - 1) if step <= WINDOW else 0), -1)
    return np.cumsum(edge)[:n_words] == 0


def _cut(text: str | None, spans: pa.Scalar) -> tuple[int, int, bytes]:
    """Words of a text, how many go, and those that stay, joined by single spaces."""
    words = split_words(text)
    n, removed = len(words), 0
    if spans.is_valid:
        mask = keep_mask(n, spans.as_py())
        removed = n - int(mask.sum())
        words = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
    return n, removed, b" ".join(words)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces; null if none went), kept_sha256."""

    def cut(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for rows in batches:
            out = []
            ids, texts = rows.column("row").flatten()
            for doc_id, text, spans in zip(ids.to_pylist(), texts, rows.column("spans"), strict=True):
                n, removed, left = _cut(text.as_py(), spans)
                out.append((doc_id, n, removed, left.decode() if removed else None, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark_repeats(plain).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, repeats cut out of their text; a text that loses words is what is left of them, joined by
    single spaces, and a document that loses all its words goes."""
    schema = docs.schema

    def cut(batches):
        for rows in batches:
            held = dict(zip(schema.names, rows.column("row").flatten(), strict=True))
            texts, stays = held["text"].to_pylist(), np.ones(rows.num_rows, bool)
            for k, spans in enumerate(rows.column("spans")):
                if spans.is_valid:
                    texts[k] = _cut(texts[k], spans)[2].decode()
                    stays[k] = bool(texts[k])
            held["text"] = pa.array(texts, held["text"].type)
            yield pa.RecordBatch.from_arrays(list(held.values()), schema.names).filter(pa.array(stays))

    return mark_repeats(docs).mapInArrow(cut, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
    SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), windows AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
    SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > least
), lists AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""
