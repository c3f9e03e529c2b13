"""Exact top-k search by inner product in a forest of M-trees.

Every vector belongs to the *cell* of its nearest center; centers are fitted on at most ``SAMPLE``
vectors of a dimension, drawn by a hash, and there are at most ``CELLS``. A cell of more than
``TREE_ROWS`` vectors is dealt into several trees. A tree is a bulk-loaded M-tree of pages: a page
stands for a ball, with its pivot, its covering radius and the distance to the pivot of the page
above; an entry of a leaf keeps its distance to the leaf's pivot. For a query q, no vector of a ball
(p, r) scores more than ``q.p + |q| r``. Search takes pages best bound first and stops at the first
that falls below the k-th score found. The triangle inequality bounds a page or entry from its
stored distance before its own product is computed, which is then mostly not needed.

Search has two rounds. In the first, each query goes to the cell of its best bound, which gives it a
k-th score; in the second, to those of the other cells whose bound reaches that score, and the search
of their trees starts from it. Queries go in blocks against a tree, and a tree is sent to the blocks
that ask for it only. Scores are exact integers, ties go to the smaller ``vec_id``, and only bounds
strictly below the k-th score discard, so the result is that of a full scan.

Components x become ``floor(256 x)``. Vectors that are null, empty, or hold null or non-finite
components, or one of 2**55 and more, which leaves 64 bits, take no part, nor do rows with a null
``vec_id``. A score beyond 64 bits counts as the largest or smallest 64-bit integer. Vectors are
compared with those of their own dimension. Rows may repeat: a query's own rows are those of its
``vec_id``; others count one by one. Empty tables give no rows. Columns other than ``vec_id`` and
``embedding`` are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import stash, table

K, QUERY_EVERY, SCALE = 5, 50, 256
#: Vectors of a page, pages under a page, vectors of a tree, queries of a block.
PAGE, FAN_OUT, TREE_ROWS, QUERY_BLOCK = 96, 24, 65_536, 1 << 15
#: Cells at most; cells at least, where each gets LEAST_ROWS vectors; vectors that centers are fitted on, at most.
CELLS, LEAST_CELLS, LEAST_ROWS, SAMPLE = 4096, 12, 2048, 16_384

_LONGEST = (1 << 63) - 1


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): the vectors that take part, in integers."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(1 << 55)))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.size(v).alias("dim"))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", centers, centers)[None, :] - 2 * x @ centers.T, axis=1)


def _moved(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Each center in the middle of what is nearest to it."""
    to = _nearest(x, centers)
    return np.array([x[to == c].mean(axis=0) if (to == c).any() else centers[c] for c in range(len(centers))])


def build_tree(ids: np.ndarray, v: np.ndarray) -> list[dict]:
    """Pages of an M-tree over rows ``v`` of integers; page 0 is the root, ``children`` are page numbers."""
    rng, pages, x = np.random.default_rng(len(ids)), [], v.astype(np.float64)

    def add(rows: np.ndarray, pivot: np.ndarray, far: np.ndarray, above: float) -> int:
        page = {"pivot": pivot, "radius": float(far.max()), "above": above}
        pages.append(page)
        at = len(pages) - 1
        if len(rows) > PAGE and page["radius"] > 0:
            seeds = x[rng.choice(rows, min(FAN_OUT, -(-len(rows) // PAGE) + 1), replace=False)]
            for _ in range(2):
                seeds = _moved(x[rows], seeds)
            to = _nearest(x[rows], seeds)
            groups = [(seeds[s], rows[to == s]) for s in range(len(seeds)) if (to == s).any()]
            if len(groups) > 1:
                page["children"] = np.array([add(g, p, _norms(x[g] - p), float(np.linalg.norm(p - pivot))) for p, g in groups])
                return at
        order = np.argsort(-far, kind="stable")
        page |= {"ids": ids[rows[order]], "v": v[rows[order]], "far": far[order], "most": float(np.abs(x[rows]).max())}
        return at

    middle = x.mean(axis=0)
    add(np.arange(len(ids)), middle, _norms(x - middle), 0.0)
    pages[0]["longest"] = float(_norms(x).max())
    for page in pages:
        if "children" in page:
            below = [pages[c] for c in page["children"]]
            page |= {"pivots": np.array([b["pivot"] for b in below]), "radii": np.array([b["radius"] for b in below]), "above_of": np.array([b["above"] for b in below])}
    return pages


def _scores(v: np.ndarray, most: float, query: np.ndarray) -> np.ndarray:
    """Exact products of integers: as doubles or 64-bit integers where neither a product nor a sum leaves them."""
    largest = most * float(np.abs(query.astype(np.float64)).max()) * v.shape[1]
    if largest < 2**52:
        return v.astype(np.float64) @ query.astype(np.float64)
    if largest < 2**62:
        return v @ query
    q = query.tolist()
    return np.array([max(-_LONGEST - 1, min(_LONGEST, sum(a * b for a, b in zip(x, q, strict=True)))) for x in v.tolist()], np.int64)


def search_tree(pages: list[dict], query: np.ndarray, own: int, k: int = K, least: int | None = None, read: list | None = None) -> list[tuple[int, int]]:
    """The (score, vec_id) of the k best rows that are not ``own``, best first, those below ``least`` left out. ``read`` gets the leaves that are read."""
    q = query.astype(np.float64)
    size = float(np.linalg.norm(q))
    best: list[tuple[int, int]] = []  # (score, -vec_id), the worst on top
    root = pages[0]
    slack = 0.5 + 1e-9 * size * root["longest"]  # scores are whole numbers, bounds are rounded
    center = float(q @ root["pivot"])
    queue = [(-(center + size * root["radius"]), 0, center)]
    while queue:
        bound, at, center = heapq.heappop(queue)
        floor = best[0][0] if len(best) == k else -np.inf
        floor = max(floor, -np.inf if least is None else least) - slack
        if -bound < floor:
            break
        page = pages[at]
        if "children" in page:
            near = np.flatnonzero(center + size * (page["above_of"] + page["radii"]) >= floor)
            if near.size:
                centers = page["pivots"][near] @ q
                bounds = np.minimum(centers + size * page["radii"][near], -bound)
                for c, b, m in zip(page["children"][near].tolist(), bounds.tolist(), centers.tolist(), strict=True):
                    if b >= floor:
                        heapq.heappush(queue, (-b, c, m))
            continue
        # entries are sorted by distance to the pivot, farthest first
        n = len(page["far"])
        if size and floor > center:
            n = int(np.searchsorted(-page["far"], -(floor - center) / size * (1 - 1e-12), "right"))
        if not n:
            continue
        if read is not None:
            read.append(at)
        scores, ids = _scores(page["v"][:n], page["most"], query), page["ids"][:n]
        hit = np.flatnonzero((scores >= floor) & (ids != own))
        if hit.size > k:
            hit = hit[np.lexsort((ids[hit], -scores[hit]))[:k]]
        for s, i in zip(scores[hit].tolist(), ids[hit].tolist(), strict=True):
            row = (int(s), -i)
            if len(best) < k:
                heapq.heappush(best, row)
            elif row > best[0]:
                heapq.heapreplace(best, row)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _rows(column) -> np.ndarray:
    return np.array(list(column), np.int64)


def find_centers(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centers of the cells of each dimension, fitted on a bounded sample."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    place = F.row_number().over(Window.partitionBy("dim").orderBy("draw"))
    share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, SAMPLE / n)))) if sizes else F.lit(None)
    drawn = vectors.withColumn("draw", F.pmod(F.xxhash64("v"), F.lit(1 << 40))).where(F.col("draw") < share[F.col("dim")] * (1 << 40)) if sizes else vectors.withColumn("draw", F.lit(0))
    sample: dict[int, list] = {}
    for r in drawn.select("dim", "v", "draw").distinct().withColumn("place", place).where(F.col("place") <= SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    centers = {}
    for d, n in sizes.items():
        x = np.array(sorted(sample.get(d) or [[0] * d]), np.float64)
        cells = min(CELLS, len(x), max(-(-n // TREE_ROWS), min(LEAST_CELLS, -(-n // LEAST_ROWS))))
        centers[d] = x[np.random.default_rng(len(x)).choice(len(x), cells, replace=False)]
        for _ in range(4):
            centers[d] = _moved(x, centers[d])
    return centers


class Forest:
    """Trees (dim, cell, part, pages as bytes, radius) as a table, and the balls of their cells."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        centers = find_centers(vectors)
        shared = self.spark.sparkContext.broadcast(centers)  # at most CELLS of a dimension

        def deal(batches):
            for batch in batches:
                dims, v = batch.column("dim").to_numpy(), batch.column("v")
                cells = np.empty(len(batch), np.int32)
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    cells[at] = _nearest(_rows(v.take(pa.array(at)).to_pylist()).astype(np.float64), shared.value[d])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

        dealt = vectors.select("vec_id", "v", "dim").mapInArrow(deal, "vec_id long, v array<long>, dim int, cell int")
        dealt = stash(dealt.withColumn("row", F.monotonically_increasing_id()), "dealt")
        parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TREE_ROWS).alias("parts"))  # a row for each cell
        split = dealt.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod("row", "parts").cast("int"))

        def build(pdf):
            import pandas as pd

            dim, cell, part = (int(pdf[c].iloc[0]) for c in ("dim", "cell", "part"))
            v = _rows(pdf["v"])
            radius = float(_norms(v - shared.value[dim][cell]).max())
            return pd.DataFrame({"dim": [dim], "cell": [cell], "part": [part], "pages": [pickle.dumps(build_tree(pdf["vec_id"].to_numpy(), v))], "radius": [radius]})

        self.trees = stash(split.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, pages binary, radius double"), "forest")
        balls: dict[int, list] = {}
        for r in self.trees.groupBy("dim", "cell").agg(F.max("radius").alias("radius")).orderBy("dim", "cell").collect():
            balls.setdefault(r["dim"], []).append((r["cell"], r["radius"]))
        numbers = {d: np.array([c for c, _ in rows]) for d, rows in balls.items()}
        self.balls = self.spark.sparkContext.broadcast({d: (numbers[d], centers[d][numbers[d]], np.array([r for _, r in rows])) for d, rows in balls.items()})

    def routed(self, queries: DataFrame, second: bool) -> DataFrame:
        """``queries`` with the cells that each asks for: that of its best bound; or the others whose bound reaches ``least``."""
        balls, names = self.balls, queries.columns

        def run(batches):
            for batch in batches:
                rows, cells = [], []
                for k, (d, v, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "v", "least")), strict=True)):
                    if d not in balls.value:
                        continue
                    number, center, radius = balls.value[d]
                    q = np.array(v, np.float64)
                    size = float(np.linalg.norm(q))
                    bound = center @ q + size * radius
                    slack = 0.5 + 1e-9 * size * (_norms(center) + radius)
                    ask = np.arange(len(bound)) == np.argmax(bound)
                    if second:
                        ask = ~ask & (bound + slack >= (-np.inf if least is None else least))
                    cells += number[ask].tolist()
                    rows += [k] * int(ask.sum())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in batch.columns), pa.array(cells, pa.int32())], [*names, "cell"])

        return queries.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", cell int")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score) of the best of each tree; ``asked`` is a written table of :meth:`routed`."""

        def run(trees, rows):
            import pandas as pd

            out = []
            if len(trees) and len(rows):
                pages = pickle.loads(trees["pages"].iloc[0])
                for own, query, least in zip(rows["query_id"].tolist(), _rows(rows["v"]), rows["least"].tolist(), strict=True):
                    out += [(own, i, s) for s, i in search_tree(pages, query, own, k, least)]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        named = lambda df, *names: df.select(*(F.col(c).alias(f"of_{c}") for c in names), *(c for c in df.columns if c not in names))
        wanted = asked.select(F.col("dim").alias("of_dim"), F.col("cell").alias("of_cell"), F.col("block").alias("of_block")).distinct()
        held = named(self.trees.drop("radius"), "dim", "cell", "part").join(wanted, ["of_dim", "of_cell"])
        parts = self.trees.select(F.col("dim").alias("d"), F.col("cell").alias("c"), "part")
        rows = asked.join(parts, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
        by = held.groupBy("of_dim", "of_cell", "of_part", "of_block")
        return by.cogroup(rows.groupBy("dim", "cell", "part", "block")).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both tables as :func:`usable_vectors` gives them."""
    forest = Forest(vectors)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    plain = queries.select(F.col("vec_id").alias("query_id"), "v", "dim", block.alias("block"), F.lit(None).cast("long").alias("least"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda rows: rows.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    first = stash(best(forest.search(stash(forest.routed(plain, False), "asked"), k)), "first")
    floors = first.where(F.col("rank") == k).select("query_id", F.when(F.col("score") > -_LONGEST - 1, F.col("score")).alias("least"))
    again = forest.routed(plain.drop("least").join(floors, "query_id", "left"), True)
    second = forest.search(stash(again, "asked"), k)
    return best(first.drop("rank").union(second))


def op10_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stash(usable_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
