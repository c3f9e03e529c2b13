"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh 5, 2, 1 and so on again; they share all words by
weight, none above three times its own. A document of a source is then wanted
``target / source_size`` times: the whole part is taken surely, the fraction is rounded. *Pivotal
rounding* pairs two undecided documents, or one with several as a whole, and moves words at random
from one to the other until one is taken or left; expectations stay, and so does the source's
number of words.

The reduction tree: documents are dealt into groups by a hash, each group is rounded on its own,
and the one document that it leaves undecided goes up, ``FAN_IN`` groups at a time. At the top
these meet two bounded lots that no group below has touched: the source's longest documents (each
longer than a ``TOP``-th of its words, so fewer than ``TOP``) and a hash-drawn reserve of about
``TOP`` others. There the longest is settled first, against all shorter ones as a whole, and so on
down, so that what a draw decides in the end is among the shortest.

A document can't be taken if it alone is longer than what is to be taken of those that are
still open, nor left out if it alone is longer than what is to be left: it has no fair draw, and at
the top it is settled the way that the others can make up for (if neither is possible, the way that
misses the target by fewer words). In the end the words still missing, fewer than a short document
has, are sought by turning over one or two of the ``SHORT`` shortest. Elsewhere every document's
expectation is its share.

Draws are seeded by the group, so reruns agree whatever the partitions. Null texts have size 0 and
are taken 0 words. Rows may repeat and ``doc_id`` may be null: each row is a document, and equal
rows are dealt into different groups. A source without words has target 0. An empty table gives no
rows. Columns other than ``doc_id``, ``text`` and ``source`` are passed through or ignored, whatever
their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import placed
from .workspace import count_words, stash, table

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents of a group at the leaves of the tree, groups that meet in one above, documents kept for the top.
LEAF, FAN_IN, TOP = 2048, 64, 1024
#: Shortest documents that may be turned over in the end. Documents of a group below the top that are paired with all smaller ones; equal rows that are dealt out together.
SHORT, LONGEST, CHUNK = 32, 64, 4096
_TINY = 1e-9

_STATE = "doc_id long, tag long, source string, size long, whole long, share double, bucket long, extra int"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs and target of each source of ``sizes`` (source, size)."""
    totals = stash(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "totals")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS))
    ordered = placed(totals, F.col("source").asc_nulls_last(), name="place")
    sources = stash(ordered.select("source", "source_size", "n_docs", weight.alias("weight"), (MOST * F.col("source_size")).alias("most")), "sources")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:  # sources that reach their limit leave more to the others
        full = F.col("most") <= level * F.col("weight")
        held = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        before = level
        level = (whole - held["held"]) / held["weight"] if held["weight"] else level
    return sources.select("source", "source_size", "n_docs", F.least("most", level * F.col("weight")).alias("target"))


def _chain(rows: list[int], size: np.ndarray, share: np.ndarray, out: np.ndarray, rng: np.random.Generator) -> int:
    """Decide ``rows`` but for one at most, whose number it gives (or -1); ``share`` keeps its share."""
    draws, held = rng.random(len(rows)).tolist(), -1
    for k, draw in zip(rows, draws, strict=True):
        if held >= 0:
            a, b, x, p = float(size[k]), float(size[held]), float(share[held]), float(share[k])
            up, down = min(b * (1 - x), a * p), min(b * x, a * (1 - p))  # words that can move to, and from, the one held
            move = up if draw * (up + down) < down else -down
            share[held], share[k] = x + move / b, p - move / a
            if not _open(share[held]):
                out[held], held = int(share[held] > 0.5), -1
        if not _open(share[k]):
            out[k] = int(share[k] > 0.5)
        elif held < 0:
            held = k
    return held


def _open(share: float) -> bool:
    return _TINY < share < 1 - _TINY


def _against_all(held: int, rest: np.ndarray, size: np.ndarray, share: np.ndarray, rng: np.random.Generator, settle: bool = False) -> None:
    """Move words between one document and the open ones of ``rest`` as a whole, until one side is settled: with ``settle`` the one."""
    rest = rest[(share[rest] > _TINY) & (share[rest] < 1 - _TINY)]
    a, p, b, x = size[rest], share[rest], float(size[held]), float(share[held])
    there, room = float((a * p).sum()), float((a * (1 - p)).sum())
    up, down = min(b * (1 - x), there), min(b * x, room)
    if up + down <= 0:
        return
    taken = rng.random() * (up + down) < down
    if settle:
        short, over = b * (1 - x) - there, b * x - room  # words that the others lack for taking it, and room for leaving it
        if max(short, over) > _TINY * b:
            taken = short <= over
    if taken:
        share[held], share[rest] = x + up / b, p * (1 - up / there) if there else p
    else:
        share[held], share[rest] = x - down / b, p + (1 - p) * (down / room) if room else p
    if settle:
        share[held] = float(taken)


def _longest_first(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each document of a group at the top."""
    rest, wanted = np.argsort(-size, kind="stable"), float((size * share).sum())
    while rest.size > 1:
        first, rest = int(rest[0]), rest[1:]
        if _open(share[first]):
            _against_all(first, rest, size, share, rng, settle=True)
    if rest.size and _open(share[rest[0]]):
        share[rest[0]] = float(rng.random() < share[rest[0]])
    out = (share > 0.5).astype(int)
    _trim(size, out, wanted)
    return out


def _trim(size: np.ndarray, out: np.ndarray, wanted: float) -> None:
    """Turn over the one or two of the shortest documents that bring the words taken nearest to ``wanted``, while any do."""
    short = np.argsort(size, kind="stable")[:SHORT]
    for _ in range(SHORT):
        missing = wanted - float((size * out).sum())
        turn = np.where(out[short] == 1, -size[short], size[short]).astype(float)
        both = turn[:, None] + turn[None, :]
        np.fill_diagonal(both, turn)
        left = np.abs(missing - both)
        i, j = np.unravel_index(np.argmin(left), left.shape)
        if left[i, j] >= abs(missing) - 1e-6:
            return
        for k in {int(i), int(j)}:
            out[short[k]] = 1 - out[short[k]]


def round_group(size: np.ndarray, share: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """0 or 1 for each document, -1 for the one still undecided, if any; ``share`` is changed.

    Below the top the ``LONGEST`` documents are paired with all smaller ones as a whole; of the others
    the larger half is rounded first and its last document against the smaller half. So what is
    undecided in the end is small, or there was too little besides it. At the top (``last``) all are decided.
    """
    if last:
        return _longest_first(size, share, rng)
    out, rest, held = np.full(len(size), -1), np.argsort(-size, kind="stable"), -1
    for _ in range(min(LONGEST, rest.size)):
        first, rest = int(rest[0]), rest[1:]
        if _open(share[first]):
            _against_all(first, rest, size, share, rng)
        if _open(share[first]):
            held = first
            break
        out[first] = int(share[first] > 0.5)
    while rest.size and held < 0:
        head, rest = rest[: (rest.size + 1) // 2], rest[(rest.size + 1) // 2 :]
        if (held := _chain(head.tolist(), size, share, out, rng)) >= 0 and rest.size:
            _against_all(held, rest, size, share, rng)
            if not _open(share[held]):
                out[held], held = int(share[held] > 0.5), -1
    for k in rest.tolist():  # none of them is open
        out[k] = int(share[k] > 0.5)
    return out


def _round_level(state: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    def run(pdf):
        import xxhash

        pdf = pdf.sort_values(["doc_id", "tag"], na_position="first").reset_index(drop=True)
        source = pdf["source"].iloc[0]
        name = f"{seed}/{level}/{pdf['bucket'].iloc[0]}/{'' if source is None else 's' + source}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name.encode()))
        share = pdf["share"].to_numpy().copy()
        pdf["extra"] = round_group(pdf["size"].to_numpy(), share, rng, last)
        pdf["share"] = share
        return pdf

    return state.groupBy("source", "bucket").applyInPandas(run, _STATE)


def _one_by_one(sizes: DataFrame) -> DataFrame:
    """A row for each document again, with its number among equal rows; equal rows come from many tasks."""
    counted = sizes.groupBy("doc_id", "tag", "source", "size").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    chunks = counted.withColumn("chunk", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / CHUNK))))
    dealt = chunks.repartition("doc_id", "tag", "chunk")
    rows = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    return dealt.select("doc_id", "tag", "source", "size", F.explode(rows).alias("number"))


def mix_counts(docs: DataFrame, seed: int = 0, tag: Column | None = None) -> DataFrame:
    """doc_id, tag, source, size, source_size, target, copies: a row for each of ``docs``.

    ``tag`` tells rows of one ``doc_id`` apart; by default a hash of the text.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit(""))) if tag is None else tag
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "source", count_words("text").alias("size"))
    sizes = stash(plain, "sizes")
    sources = stash(source_targets(sizes), "targets")
    named = sources.select(F.col("source").alias("of"), "source_size", "n_docs", "target")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + _TINY).cast("long")
    leaves = F.ceil(F.col("n_docs") / LEAF).cast("long")
    place = F.xxhash64(F.lit(seed), "doc_id", "tag", "number")
    kept_back = (leaves == 1) | (F.col("size") * TOP > F.col("source_size")) | (F.pmod(place, F.col("n_docs")) < TOP)
    state = stash(
        _one_by_one(sizes).join(named, F.col("source").eqNullSafe(F.col("of"))).select(
            "doc_id", "tag", "source", "size", whole.alias("whole"),
            F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wanted - whole)).otherwise(0.0).alias("share"),
            F.when(kept_back, F.lit(-1)).otherwise(F.pmod(F.xxhash64(place), leaves)).cast("long").alias("bucket"), F.lit(-1).alias("extra"),
        ),
        "shares",
    )
    undecided = F.col("share").between(_TINY, 1 - _TINY)
    done = [state.where(~undecided).withColumn("extra", (F.col("share") > 0.5).cast("int"))]
    top = state.where(undecided & (F.col("bucket") < 0))
    state = state.where(undecided & (F.col("bucket") >= 0))
    width, level = ceil((sources.agg(F.max("n_docs")).first()[0] or 0) / LEAF), 0
    while width > 1:
        now = stash(_round_level(state, level, False, seed), "rounded")
        done.append(now.where("extra >= 0"))
        state = now.where("extra < 0").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        width, level = (ceil(width / FAN_IN) if width > FAN_IN else 1), level + 1
    last = top.union(state).withColumn("bucket", F.lit(0).cast("long"))
    done.append(stash(_round_level(last, level, True, seed), "rounded"))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.union(more)
    return rounded.join(named, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "tag", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; maps, which have no order, as their JSON."""
    return F.xxhash64(*(F.to_json(F.col(f"`{c}`")) if kind.startswith("map<") else F.col(f"`{c}`") for c, kind in docs.dtypes))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is taken. Equal rows share their copies."""
    key, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), row_hash(docs)
    counts = mix_counts(docs, seed, tag).groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "tag").agg(F.sum("copies").alias("copies"))
    rows = docs.select(key.alias("key"), tag.alias("tag"), F.struct(*docs.columns).alias("row")).dropDuplicates(["key", "tag"])
    taken = rows.join(counts.where("copies > 0"), ["key", "tag"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mix_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
