"""Near copies: components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

This is operator 7's search, pivot tables of Hamming distances, over fingerprints that can say so.
A SimHash of 64 bits can't: such pairs differ in up to 14 bits, no bound holds for all of them, and 14
of 64 leave no blocks to deal out by. Here a fingerprint has ``BITS`` bits, each the parity of the
shingles that hash to it: a shingle that only one of two sets has turns over one bit, so two
fingerprints never differ in more bits than the sets do in shingles. Sets of ``n`` and ``m`` shingles
that link differ in at most ``(n + m) / 9``. Every pair at the threshold links; nothing is sampled or
capped:

* texts of equal sets are one, a *set*, known by a 64-bit hash as shingles are;
* two sets that link share at least ``0.8 n`` shingles of either, thus ``c`` of the ``n - 0.8 n + c``
  smallest hashes (*head*) of both. A set whose head repeats fewer elsewhere has no near copy;
* among those left, shingles are counted: ``0.8 n`` of a set must be in other sets, too;
* ordered by count, rarest first, two sets that link share one of the first ``n - 0.8 n + 1``.
  Sets that share one are joined to *families* by a star for each shingle, never by its pairs;
* in a family, a table of the fingerprints' distances to reference fingerprints (pivots, each the one
  farthest from those before it) discards a pair whose distances to any pivot differ by more than
  the sets may; then the fingerprints themselves are compared, and the shingles of what survives.

A family is compared in one task; one of over BLOCK shingles is cut in blocks, and each pair of
blocks is a task. A task emits a forest, not its pairs.

Null texts and texts without words have the empty set and are copies of each other. Null or repeated
``doc_id`` are rows like others. Columns of any name pass through: they travel as one. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.components import connected_components
from .simhash import listed, one_of_each, place_of, survivors
from .workspace import release, stash

SHINGLE, SEED = 5, 42
#: The least similarity is TOP / BELOW.
TOP, BELOW = 4, 5
#: Bits of a fingerprint, and reference fingerprints of a family.
BITS, PIVOTS = 2048, 16
#: Shingles of a block; texts of a slice in a worker, and words whose hashes it remembers.
BLOCK, SLICE, MAX_WORDS = 1 << 18, 500, 200_000

_ODD = np.random.default_rng(5).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; of fewer words, the text is one shingle."""
    import xxhash

    known = {} if known is None else known
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    x = np.array([known[w] for w in words] + [0] * (SHINGLE - len(words)), np.uint64)
    n = len(x) - SHINGLE + 1
    return np.unique(_mixed(sum((x[k : k + n] * _ODD[k] for k in range(SHINGLE)), np.zeros(n, np.uint64))).view(np.int64))


def least_shared(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with one that it links with."""
    return -(-TOP * n // BELOW)


def _more(n: int) -> int:
    return 1 + n // 20


def _slices(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            part = batch.slice(k, SLICE)
            yield part, [shingles(t.as_py(), known) for t in part.column("text")]
            if len(known) > MAX_WORDS:
                known.clear()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), text, key (of the set), n (its size), least (heads must repeat so many), head and id."""
    import xxhash

    plain = docs.select(F.struct(*docs.columns).alias("row"), "text")
    more = [StructField(c, LongType()) for c in ("key", "n", "least")] + [StructField("head", ArrayType(LongType()))]

    def run(batches):
        for part, sets in _slices(batches):
            key = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            size = [len(s) for s in sets]
            heads = [s[: n - least_shared(n) + _more(n)] if n else s for s, n in zip(sets, size, strict=True)]
            columns = [pa.array(key), pa.array(size, pa.int64()), pa.array([_more(least_shared(n)) for n in size], pa.int64()), _lists(heads)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", *(f.name for f in more)])
        release()

    found = plain.mapInArrow(run, StructType([plain.schema["row"], *more]))
    return found.withColumn("id", F.monotonically_increasing_id())


def candidates(rows: DataFrame) -> DataFrame:
    """(key, n, shingles) of each set whose head repeats enough shingles; ``rows`` is a written table of ``keyed``."""
    by_shingle = Window.partitionBy("shingle")
    heads = rows.select(F.explode("head").alias("shingle"), "key", "least")
    shared = heads.withColumns({"lo": F.min("key").over(by_shingle), "hi": F.max("key").over(by_shingle)}).where("lo <> hi")
    # copies of a set repeat its head; the quotient by their number is what the set itself has
    some = shared.groupBy("key").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    picked = stash(some.join(copies, "key").where(F.col("n") >= F.col("least") * F.col("copies")).select("id"), "picked")

    def run(batches):
        for part, sets in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["key", "n", "shingles"])

    texts = rows.select("id", "key", F.col("row.text").alias("text")).join(listed(picked), "id").select("key", "text")
    return stash(texts.mapInArrow(run, "key long, n long, shingles array<long>"), "sets")


def families(sets: DataFrame) -> DataFrame:
    """(node, component): sets by key that links can join."""
    by_shingle = Window.partitionBy("shingle")
    counted = sets.select("key", "n", F.explode("shingles").alias("shingle")).withColumn("count", F.count("*").over(by_shingle)).where("count > 1")
    rare_first = F.array_sort(F.collect_list(F.struct("count", "shingle")))
    least = F.ceil(F.col("n") * TOP / BELOW)
    listed = counted.groupBy("key", "n").agg(rare_first.alias("held")).where(F.size("held") >= least)
    first = listed.select("key", F.explode(F.slice("held", F.lit(1), (F.size("held") - least + 1).cast("int"))).alias("x")).select("key", "x.shingle")
    return connected_components(first.select("key", F.min("key").over(by_shingle).alias("least")).where("key <> least").distinct(), "key", "least")


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BITS bits for each set, in 64-bit words: whether an odd number of its shingles falls on a bit."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for k, s in enumerate(sets):
        out[k] = np.packbits(np.bincount(s.view(np.uint64) % np.uint64(BITS), minlength=BITS).astype(np.uint8) & 1)
    return out.view(np.uint64)


def _apart(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(some ^ one).sum(axis=1, dtype=np.int32)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of all fingerprints to up to PIVOTS of them, each the farthest from those before it."""
    columns, at = [], 0
    for _ in range(min(PIVOTS, len(fp))):
        columns.append(_apart(fp, fp[at]))
        nearest = columns[-1] if len(columns) == 1 else np.minimum(nearest, columns[-1])
        at = int(np.argmax(nearest))
        if not nearest[at]:
            break
    return np.stack(columns, axis=1)


def forest(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what links join among ``sets``; with ``side``, of links between different sides only."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    fp = fingerprints(sets)
    far, label, edges = pivot_table(fp), np.arange(m), []
    for k in range(m - 1):
        to = np.flatnonzero(label != label[k])
        if not to.size:
            break
        to = to[to > k] if side is None else to[(to > k) & (side[to] != side[k])]
        most = (size[to] + size[k]) * (BELOW - TOP) // (BELOW + TOP)  # shingles that only one of two sets that link has
        to = to[survivors(far, np.full(len(to), k), to, most)]
        most = (size[to] + size[k]) * (BELOW - TOP) // (BELOW + TOP)
        for j in to[_apart(fp[to], fp[k]) <= most].tolist():
            if label[j] != label[k]:
                both = np.intersect1d(sets[k], sets[j], assume_unique=True).size
                if (TOP + BELOW) * both >= TOP * int(size[k] + size[j]):  # both / (size + size - both) >= TOP / BELOW
                    label[label == label[j]] = label[k]
                    edges.append((k, j))
    return edges


def links(sets: DataFrame, family: DataFrame) -> DataFrame:
    """Edges (a, b) between keys whose components are those of all links."""
    placed = stash(sets.join(family, sets["key"] == family["node"]).select("key", "n", "shingles", "component"), "placed")
    blocks = placed.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = placed.join(blocks, "component").select("component", "key", "shingles", own.alias("own"), other.alias("other"))
    run = ["component", "i", "j"]
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "shingles")

    def compare(batches):
        at, held = None, []
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in run), strict=True)
            values = batch.column("shingles")
            for k, name in enumerate(names):
                if name != at:
                    yield from edges(held)
                    at, held = name, []
                held.append((batch.column("key")[k].as_py(), batch.column("own")[k].as_py(), values[k].values.to_numpy()))
        yield from edges(held)

    def edges(held):
        if len(held) < 2:
            return
        keys, sides, own_sets = zip(*held, strict=True)
        side = np.array(sides)
        found = forest(list(own_sets), side if (side != side[0]).any() else None)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([keys[x[e]] for x in found], pa.int64()) for e in (0, 1)], ["a", "b"])

    return dealt.repartition(*run).sortWithinPartitions(*run).mapInArrow(compare, "a long, b long")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest ``doc_id``, nulls last; of equal ones, by a hash of the row."""
    rows = stash(keyed(docs), "keyed")
    sets = candidates(rows)
    joined = connected_components(links(sets, families(sets))).select(F.col("node").alias("key"), "component")
    labelled = rows.select("key", place_of(docs).alias("place")).join(joined, "key", "left")
    return one_of_each(rows, labelled.select("place", F.coalesce("component", "key").alias("root")))
