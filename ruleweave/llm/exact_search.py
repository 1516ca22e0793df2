"""Exact nearest vectors by inner product, with a KD-tree per shard.

Vectors are dealt to shards of about SHARD_ROWS. A shard's tree splits at the
median of its widest side and keeps tight bounding boxes. A query walks the tree
best first, by the largest inner product that a box allows, and stops when no box
reaches its k-th score so far. A query goes to one shard first, then with the score
found there to a few, and then with that to the others; a vector goes to its shard
alone. A task holds one shard's vectors, past which the queries stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bare, kept

SHARD_ROWS = 8192
#: One of so many shards is searched in the second round.
FEW = 8
#: Queries whose bounds are held at once.
QUERY_ROWS = 512
LEAF = 128
#: Beyond this, sums could leave the whole numbers that a double holds, and 64-bit integers are used.
_SAFE = float(1 << 53)
#: Stands for a null id, before all others.
_NO_ID = -(1 << 63)


class Tree:
    """Vectors in leaves; nodes in breadth-first order with their boxes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids = x, ids
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        low, high, todo = [], [], [np.arange(len(x))]
        while len(self.rows) < len(todo):
            rows = todo[len(self.rows)]
            low.append(x[rows].min(0))
            high.append(x[rows].max(0))
            side = int(np.argmax(high[-1] - low[-1]))
            if len(rows) <= leaf or high[-1][side] == low[-1][side]:
                self.rows.append(rows[np.argsort(ids[rows], kind="stable")])
                self.children.append(None)
                continue
            half = len(rows) // 2
            order = np.argpartition(x[rows, side], half)
            self.rows.append(None)
            self.children.append((len(todo), len(todo) + 1))
            todo += [rows[order[:half]], rows[order[half:]]]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product with any point of each box, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int | None, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) of at least `least`, ties to smaller ids; own: the id to leave out."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.x[rows] @ query
            good = scores >= least
            if own is not None:
                good &= self.ids[rows] != own
            if good.any():
                best += zip(scores[good].tolist(), self.ids[rows[good]].tolist(), strict=True)
                best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return [(int(s), i) for s, i in best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class _Shard:
    """The vectors of one shard and length, and the tree once a query comes."""

    def __init__(self, dim: int):
        self.dim, self.parts, self.tree = dim, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((_matrix(rows.column("v"), self.dim), rows.column("id").fill_null(_NO_ID).to_numpy()))

    def search(self, rows: pa.RecordBatch, k: int) -> Iterator[tuple]:
        if not self.parts or not self.dim:
            return
        q = _matrix(rows.column("v"), self.dim)
        if self.tree is None:
            x, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.largest = float(np.abs(x).max())
            self.whole, self.tree = x, Tree(x.astype(np.float64), ids)
        tree = self.tree
        if self.largest * float(np.abs(q).max(initial=0)) * self.dim >= _SAFE:
            tree = Tree(self.whole, tree.ids)
        else:
            q = q.astype(np.float64)
        bounds = tree.bounds(q)
        for i, (row, own, least) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("row", "id", "least")), strict=True)):
            for score, n in tree.search(q[i], own, bounds[i], k, -np.inf if least is None else least):
                yield row, own, score, None if n == _NO_ID else n


def _searched(k: int):
    """Rows in order of shard, length and kind: vectors (0), then queries (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            names = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "dim", "kind")])
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1 if len(names) else ()
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if at != tuple(names[a, :2]):
                    at, shard = tuple(names[a, :2]), _Shard(int(names[a, 1]))
                if names[a, 2] == 0:
                    shard.add(batch.slice(a, b - a))
                else:
                    for i in range(a, b, QUERY_ROWS):
                        out += shard.search(batch.slice(i, min(QUERY_ROWS, b - i)), k)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=["row", "query_id", "score", "id"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products, ties to smaller ids.

    vectors and queries: an id (long) and a vector (array of long; null or holding
    null: no part). Rows of the query's own id are left out; vectors of another
    length than the query's are no candidates; a null id comes first among ties.
    Repeated queries are one; repeated vectors are candidates each. Fewer candidates
    than k are all returned. Vectors beyond 64-bit sums wrap.
    """

    def shaped(df: DataFrame) -> DataFrame:
        df = bare(df, id=id_col, v=vector_col)
        whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
        return df.where(whole).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v"), F.size("v").alias("dim"))

    asked = kept(shaped(queries).distinct().withColumn("row", F.xxhash64("id", "v")), "asked-vectors")
    rows = shaped(vectors)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.select(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "id", F.lit(None).cast("long").alias("least"), "v")
    home = F.pmod(F.col("row"), F.lit(shards)).cast("int")
    order = ["shard", "dim", "kind"]

    def searched(some: DataFrame, shard: Column) -> DataFrame:
        """What queries (row, id, v, dim, least) find in the shards named."""
        sent = some.select(shard.alias("shard"), "dim", F.lit(1).alias("kind"), "row", "id", "least", "v")
        dealt = rows.unionByName(sent).repartition("shard", "dim").sortWithinPartitions(*order)
        return dealt.mapInArrow(_searched(k), "row long, query_id long, score long, id long")

    def best(found: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), F.asc_nulls_first("id"))
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    def bounded(found: DataFrame) -> DataFrame:
        least = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k).select("row", "bound")
        return asked.join(least, "row", "left").withColumnRenamed("bound", "least")

    found = kept(best(searched(asked.withColumn("least", F.lit(None).cast("long")), home)).drop("rank"), "found-at-home")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    rest = lambda keep: F.explode(F.filter(every, keep))
    few = max(1, shards // FEW)  # shards 0, few, 2 few, ...: about FEW of them
    if shards > 4 * FEW:
        second = searched(bounded(found), rest(lambda x: (x != home) & (x % few == 0)))
        found = kept(best(found.union(second)).drop("rank"), "found-in-few")
        others = rest(lambda x: (x != home) & (x % few != 0))
    else:
        others = rest(lambda x: x != home)
    out = best(found.union(searched(bounded(found), others)))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of every component as long; null for vectors that are null or hold null or non-finite components."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c * by).cast("long")))
