"""SimHash fingerprints and the near-duplicate components they form.

A fingerprint bit is set if over half of the document's shingle hashes have it. Documents link
where fingerprints differ in at most ``distance`` bits; a component is all that links reach.

Only distinct fingerprints are compared. The 64 bits are cut in blocks, and two fingerprints within
the distance agree on all but ``distance`` of them, so each fingerprint is dealt out by every
choice of the other blocks and no link is lost. Among those that share a choice, a table of Hamming
distances to reference fingerprints (pivots) discards a pair whose distances to any pivot
differ by more than ``distance``, and an exclusive-or verifies the survivors. Pairs that are
found only join components: a group emits the edges of a forest, never all its pairs, and a group
of thousands is dealt again by the bits that its members need not share.

Null texts and texts without words have fingerprint zero and link like others. Repeated rows
link as equal fingerprints do. A null ``doc_id`` takes part, and ``component_id`` is the smallest
one reached that isn't null (null if there is none). An empty table gives no rows. Columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .workspace import stash, table

SHINGLE, DISTANCE, SEED, PIVOTS = 4, 4, 42, 24
#: Rows up to which a list of rows is broadcast. Groups up to SMALL are compared by shifts, those over LARGE are cut again: DEALS times
#: before they meet in a task, and in it.
BROADCAST, SMALL, LARGE, DEALS = 1 << 21, 24, 8192, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - shingle)
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(distance: int, blocks: int) -> list[int]:
    """Bits to share, for each choice of all but ``distance`` blocks."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, PIVOTS, np.uint64)


def survivors(far: np.ndarray, one: np.ndarray, to: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Which of the pairs (one, to) the pivot table ``far`` doesn't discard: those apart by at most ``most`` in every coordinate."""
    kept = np.arange(len(one))
    most = np.broadcast_to(most, len(one))
    for p in range(far.shape[1]):
        kept = kept[np.abs(far[one[kept], p] - far[to[kept], p]) <= most[kept]]
        if not kept.size:
            break
    return kept


def _near(fp: np.ndarray, far: np.ndarray, one: np.ndarray, to: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (one, to) link: by the pivot table ``far`` first, then by all bits."""
    kept = survivors(far, one, to, distance)
    return kept[np.bitwise_count(fp[one[kept]] ^ fp[to[kept]]) <= distance]


def forest(fp: np.ndarray, free: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links join among distinct ``fp``, which may differ in the bits of ``free`` only."""
    n = len(fp)
    bits = [b for b in range(64) if free >> b & 1]
    if n > LARGE and len(bits) > distance:
        out = []
        for mask in _free_parts(~free & ((1 << 64) - 1), distance + 1):  # one of the parts has no difference
            key = fp & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for rows in np.split(order, cut):
                if len(rows) > 1:
                    a, b = forest(fp[rows], free & ~mask, distance)
                    out.append((rows[a], rows[b]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
    far = np.bitwise_count(fp[:, None] ^ _pivots()[None, :]).astype(np.int8)
    waiting, a, b = np.arange(1, n), [], []
    queue = [0]
    while queue or waiting.size:
        if not queue:
            queue, waiting = [int(waiting[0])], waiting[1:]
        at = queue.pop()
        if waiting.size:
            hit = _near(fp, far, np.full(len(waiting), at), waiting, distance)
            found = waiting[hit]
            a.append(np.full(len(found), at))
            b.append(found)
            queue += found.tolist()
            waiting = np.delete(waiting, hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _link_runs(table_no: np.ndarray, key: np.ndarray, fp: np.ndarray, masks: list[int], distance: int):
    """Edges within the runs of rows of equal (table_no, key); rows are sorted by both."""
    n = len(fp)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (table_no[1:] != table_no[:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    out = []
    for s, k in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        some = fp[s : s + k]
        a, b = forest(some, ~masks[table_no[s]] & ((1 << 64) - 1), distance)
        out.append((some[a], some[b]))
    small = np.repeat((size > 1) & (size <= SMALL), size)
    rows = np.flatnonzero(small)
    if rows.size:
        some, run = fp[rows], np.repeat(np.arange(len(size)), size)[rows]
        far = np.bitwise_count(some[:, None] ^ _pivots()[None, :]).astype(np.int8)
        for t in range(1, SMALL):
            one = np.flatnonzero(run[:-t] == run[t:]) if t < len(run) else np.zeros(0, int)
            if not one.size:
                break
            hit = _near(some, far, one, one + t, distance)
            out.append((some[one[hit]], some[one[hit] + t]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (fp[:0], fp[:0])


def _dealt(distinct: DataFrame, distance: int, blocks: int) -> tuple[DataFrame, list[int]]:
    """(table_no, key, fp), and the bits of each table that a key has.

    A key of over LARGE fingerprints is dealt again by the bits that it leaves free: cut in ``distance + 1``
    parts, one of them has no difference. So groups are split before they meet in a task.
    """
    masks = _masks(distance, blocks)
    fp, table_no = F.col("fp"), F.col("table_no")
    keys: list[Column] = [F.struct(F.lit(k).alias("table_no"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.table_no", "k.key", "fp")
    first = 0
    for _ in range(DEALS):
        hot = stash(dealt.groupBy("table_no", "key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("table_no", "key"), "hot")
        if hot.isEmpty():
            break
        base, parts = len(masks), distance + 1
        finer = [m | p for m in masks[first:] for p in _free_parts(m, parts)]
        masks, start = masks + finer, first
        bits = F.array(*(F.lit(_signed(m)) for m in finer))
        at = [(table_no - start) * parts + p for p in range(parts)]
        keys = [F.struct((F.lit(base) + k).cast("int").alias("table_no"), fp.bitwiseAND(F.get(bits, k)).alias("key")) for k in at]
        again = dealt.join(hot, ["table_no", "key"], "left_semi").select("fp", F.explode(F.array(*keys)).alias("k")).select("k.table_no", "k.key", "fp")
        dealt, first = dealt.join(hot, ["table_no", "key"], "left_anti").select("table_no", "key", "fp").union(again), base
    return dealt, masks


def _free_parts(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut in parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free, np.int64), parts)]


def link_fingerprints(distinct: DataFrame, distance: int = DISTANCE, blocks: int = 6) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    dealt, masks = _dealt(distinct, distance, blocks)

    def link(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("table_no", "key", "fp")]
            now[2] = now[2].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, k, f = now
            cut = int(np.flatnonzero((k == k[-1]) & (t == t[-1]))[0]) if len(k) else 0
            held = [x[cut:].copy() for x in now]  # the last run may go on in the next batch
            if cut:
                yield edges(t[:cut], k[:cut], f[:cut])
        if held is not None and len(held[0]):
            yield edges(*held)

    def edges(t, k, f):
        a, b = _link_runs(t, k, f, masks, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("table_no", "key").sortWithinPartitions("table_no", "key").mapInArrow(link, "a long, b long").distinct()


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (a written table with doc_id and fp) with component_id."""
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = distinct.count()
    blocks = next((b for b in (6, 7) if n < 1 << (64 * (b - distance) // b)), 8)
    assert comb(blocks, distance) <= 70
    reached = connected_components(link_fingerprints(distinct, distance, blocks))
    rooted = distinct.join(reached, distinct["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = stash(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stash(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each document."""
    found = components(stash(fingerprints(docs, shingle), "prints"), distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def place_of(docs: DataFrame) -> Column:
    """Which row of a group comes first, for rows (row, a struct of the columns of ``docs``, id): the smallest ``doc_id``, nulls last; then by a hash of the row."""
    doc_id = F.col("row.doc_id")
    hashed = F.xxhash64(*(F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    return F.struct(doc_id.isNull().alias("last"), doc_id.cast("long").alias("doc_id"), hashed.alias("hash"), "id")


def one_of_each(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """The ``row`` of the first of each group; ``rows`` is a written table (row, id), ``labelled`` has (place, root) of each."""
    labelled = stash(labelled, "labelled")
    # written, so that the join has exchanges of its own, whose hot groups Spark can split
    least = stash(labelled.groupBy("root").agg(F.count("*").alias("n"), F.min("place").alias("least")).where("n > 1").select("root", "least"), "least")
    gone = stash(labelled.join(listed(least), "root").where("place.id <> least.id").select("place.id"), "gone")
    return rows.join(listed(gone), "id", "left_anti").select("row.*")


def listed(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be broadcast if they are at most BROADCAST."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest ``doc_id``, nulls last; of equal ones, by a hash of the row."""
    rows = stash(docs.select(F.struct(*docs.columns).alias("row")).withColumn("id", F.monotonically_increasing_id()), "rows")
    found = components(stash(fingerprints(rows.select(F.col("id").alias("doc_id"), "row.text"), shingle), "prints"), distance)
    roots = found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("root"))
    return one_of_each(rows, rows.select("id", place_of(docs).alias("place")).join(roots, "id").select("place", "root"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
