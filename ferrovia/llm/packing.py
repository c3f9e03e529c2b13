"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Documents are sorted by length: all documents of one length are a
*run*, and a document's place in its run is its rank. Gaps, the free ends of open sequences, are
runs as well: sequences that follow one another and have the same room left. A superstep takes
the longest documents that are not placed, a band of lengths:

1. documents of the band and gaps are dealt into ranges of sizes, and each range is swept by a
   task of its own from the longest document down: it takes its successor, the smallest gap
   that holds it. Of the documents that want the same gaps the k-th by rank gets the k-th;
2. what finds no gap in its range goes up: documents and gaps left by the sweeps meet in a
   second sweep, where a document's successor may lie in any longer range, and documents that
   still find none open sequences;
3. the places, and the gaps as they are now, are written; the next superstep reads them.

Lengths are at most the capacity, so there are at most ``capacity`` runs of documents however
large the corpus is, and the runs of gaps come from splitting those. Counting the runs, ranking,
and giving each document the place of its rank are joins over all rows; the table of places
has rows for each split of a run, which the capacity bounds, and is the only thing broadcast.

Null texts are empty and hold the end id alone. Null or repeated ``doc_id`` are separate
documents. An empty table packs into no sequence. Columns other than ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokenizing import END_ID, default_path, encoder
from .workspace import release, stash, table

CAPACITY = 1024
#: Bands end where so many documents of a length no longer fit in a sequence. Sizes of a range.
BANDS, RANGE = (2, 3, 4, 6, 8, 12, 24, 64), 64
#: Bytes of text that a worker turns into pieces at a time.
SLICE_BYTES = 2 << 20


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: as many full ones as it holds, after one with the rest.

    ``part`` and ``rank_in_part`` number the pieces of one length in each partition. With
    ``keep_ids`` a column ``ids`` has the token ids themselves.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank_in_part", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def pieces_of(keys: pa.Array, ids: np.ndarray, n: np.ndarray, part: int, seen: np.ndarray) -> pa.RecordBatch:
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = n - (pieces - 1) * capacity
        length = np.where(piece > 0, capacity, head[doc])
        start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
        at = (np.cumsum(n) - n)[doc] + start
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        here = np.bincount(length, minlength=capacity + 1)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - (np.cumsum(here) - here)[length[order]]
        rank += seen[length]
        seen += here
        columns = [keys.take(pa.array(doc)), piece, start, length, crc, np.full(len(doc), part), rank]
        if keep_ids:  # pieces follow one another as their ids do
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for ids, lengths in encoder(tokenizer, end_id).encode(batch.column("text"), SLICE_BYTES):
                yield pieces_of(keys.slice(at, len(lengths)), ids, lengths, part, seen)
                at += len(lengths)
        release()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + ", ids array<int>" * keep_ids)


#: A run of documents (ranks low to high of a length), a run of gaps (sequences low to high), or a
#: place: documents low to high of a length go ``each`` to a sequence, from ``first`` on, at offset ``at``.
_RUN = "kind string, size long, low long, high long, each long, first long, at long"


def sweep(docs: list, gaps: list, capacity: int, opened: int | None) -> tuple[list, list, list]:
    """Best fit of runs of documents (length, low, high), the longest first, into runs of gaps (size, low, high).

    Gives places, documents left over and gaps left over. With ``opened``, the number of sequences so
    far, a document without a successor opens one; without, it is left over.
    """
    gaps, places, left = sorted(gaps), [], []
    for length, low, high in sorted(docs, reverse=True):
        while low < high:
            k = bisect.bisect_left(gaps, (length,))
            if k < len(gaps):
                size, first, last = gaps.pop(k)
            elif opened is None:
                left.append((length, low, high))
                break
            else:
                size, first = capacity, opened
                last = opened = first + -(-(high - low) // (capacity // length))
            each = size // length
            whole = min(last - first, (high - low) // each)
            for n, many in ((whole, each), (int(first + whole < last and low + whole * each < high), high - low - whole * each)):
                if n:
                    places.append((length, low, low + n * many, many, first, capacity - size))
                    if rest := size - many * length:
                        bisect.insort(gaps, (rest, first, first + n))
                    low, first = low + n * many, first + n
            if first < last:
                bisect.insort(gaps, (size, first, last))
    return places, left, gaps


def _superstep(runs: DataFrame, capacity: int, opened: int) -> DataFrame:
    """``runs`` of documents and gaps after both sweeps: places and gaps."""
    import pandas as pd

    names = ["kind", "size", "low", "high", "each", "first", "at"]

    def swept(pdf, opened):
        rows = {kind: list(pdf.loc[pdf["kind"] == kind, ["size", "low", "high"]].itertuples(index=False, name=None)) for kind in ("doc", "gap")}
        places, left, gaps = sweep(rows["doc"], rows["gap"], capacity, opened)
        out = [("place", *p) for p in places] + [("doc", *d, 0, 0, 0) for d in left] + [("gap", *g, 0, 0, 0) for g in gaps]
        return pd.DataFrame(out, columns=names)

    def in_range(pdf):
        return swept(pdf, None)

    def together(pdf):
        return pdf if pdf["kind"].iloc[0] == "place" else swept(pdf, opened)

    ranges = runs.groupBy(F.floor(F.col("size") / RANGE)).applyInPandas(in_range, _RUN)
    return ranges.groupBy(F.when(F.col("kind") == "place", F.col("size"))).applyInPandas(together, _RUN)


def find_places(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places (length, low, high, each, first, at) of all documents; ``counts`` is a written table (length, n)."""
    spark, opened, none = counts.sparkSession, 0, F.lit(0).cast("long")
    fit = F.floor(F.lit(capacity) / F.col("length"))
    band = sum(((fit >= k).cast("int") for k in BANDS), F.lit(0))
    docs = counts.select(F.lit("doc").alias("kind"), F.col("length").alias("size"), none.alias("low"), F.col("n").alias("high"), none.alias("each"), none.alias("first"), none.alias("at"), band.alias("band"))
    gaps = places = spark.createDataFrame([], _RUN)
    for b in sorted(r["band"] for r in docs.select("band").distinct().collect()):  # at most one more than BANDS
        least = capacity // BANDS[b] + 1 if b < len(BANDS) else 1
        in_play = docs.where(F.col("band") == b).drop("band").union(gaps.where(F.col("size") >= least))
        done = stash(_superstep(in_play, capacity, opened), "superstep")
        places = places.union(done.where("kind = 'place'"))
        gaps = done.where("kind = 'gap'").union(gaps.where(F.col("size") < least))
        opened = max(opened, done.where("kind = 'place'").agg(F.max(F.col("first") + F.ceil((F.col("high") - F.col("low")) / F.col("each")))).first()[0] or 0)
    return places.select(F.col("size").alias("length"), "low", "high", "each", "first", "at")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a written table, as it is read twice."""
    sizes = stash(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    by_part = Window.partitionBy("length").orderBy("part")
    before = sizes.select("length", "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"))
    where = find_places(stash(sizes.groupBy("length").agg(F.sum("n").alias("n")), "runs"), capacity)
    rank = F.col("before") + F.col("rank_in_part")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", rank).drop("before", "part", "rank_in_part")
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(where["length"])
    step = F.col("rank") - F.col("low")
    return placed.withColumns({"sequence_id": F.col("first") + F.floor(step / F.col("each")).cast("long"), "offset": F.col("at") + (step % F.col("each")) * F.col("length")}).drop("rank", "low", "high", "each", "first", "at")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its ids)."""
    return place_pieces(stash(cut_pieces(docs, tokenizer or default_path(), capacity, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packing that kept its ids; a sequence holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
