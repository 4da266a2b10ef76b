"""Dot products of all rows with a set of queries, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.ship import map_arrow

#: Queries that one task holds, about; the rows that it meets come in a stream and are not held. Rows are cut into so many blocks at least.
BLOCK_QUERIES, ROW_BLOCKS = 32_768, 4
#: Queries and rows whose products are taken at once.
TILE = 512, 2048


def _vectors(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


class _Best:
    """The k best rows of each query so far, and a bound: no score below it can be among them."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.groups, self.x, self.k = ids, groups, x, k
        self.least = np.full(len(ids), -np.inf)
        self.rows = np.zeros((0, 2), np.int64)  # place of the query, id of the row
        self.scores = np.zeros(0)
        self.waiting: list = []
        self.n_waiting = 0

    def meet(self, ids: np.ndarray, groups: np.ndarray, x: np.ndarray) -> None:
        for lo in range(0, len(ids), TILE[1]):
            row_ids, row_groups, turned = ids[lo : lo + TILE[1]], groups[lo : lo + TILE[1]], np.ascontiguousarray(x[lo : lo + TILE[1]].T)
            for at in range(0, len(self.ids), TILE[0]):
                s = self.x[at : at + TILE[0]] @ turned
                least = self.least[at : at + TILE[0]]
                if np.isneginf(least).any():
                    s[self.groups[at : at + TILE[0], None] == row_groups[None, :]] = -np.inf
                    if s.shape[1] >= self.k:
                        np.maximum(least, np.round(np.partition(s, -self.k, axis=1)[:, -self.k], 6), out=least)
                # scores count rounded to 6 digits, ties by id; a hair below the bound may still round up to it
                i, j = np.nonzero(s >= np.maximum(least - 1e-6, -np.finfo(np.float64).max)[:, None])
                apart = self.groups[at + i] != row_groups[j]
                i, j = i[apart], j[apart]
                self.waiting.append((np.stack([at + i, row_ids[j]], axis=1), np.round(s[i, j], 6)))
                self.n_waiting += len(i)
                if self.n_waiting > max(1 << 20, 2 * len(self.scores)):
                    self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *[r for r, _ in self.waiting]])
        scores = np.concatenate([self.scores, *[s for _, s in self.waiting]])
        order = np.lexsort((rows[:, 1], -scores, rows[:, 0]))
        rows, scores = rows[order], scores[order]
        n = np.bincount(rows[:, 0], minlength=len(self.ids))
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        last = rank == self.k - 1
        self.least[rows[last, 0]] = scores[last]
        self.rows, self.scores = rows[rank < self.k], scores[rank < self.k]
        self.waiting, self.n_waiting = [], 0


def block_top_k(df: DataFrame, key: str, group: str, vec: str, k: int, blocks: int | None = None, queries: Column | None = None) -> DataFrame:
    """The k highest dot products of each row, or of those that ``queries`` picks, with rows of another group. Each query is sent to one cell of a
    (query block, row block) grid for every row block, and each row to one for every query block. A cell holds its
    queries and meets its rows in a stream; the best so far bound what is looked at further. Cells give each query's k best, and those are ranked. By default there are as
    many query blocks as leave about ``BLOCK_QUERIES`` to each; ``blocks`` sets the number of both. Work is queries times rows by nature."""
    asks = (F.lit(True) if queries is None else queries).alias("asks")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("v"), asks).where("v is not null")
    across = blocks or max(1, -(-rows.where("asks").count() // BLOCK_QUERIES))
    along = blocks or max(ROW_BLOCKS, -(-4 * ROW_BLOCKS // across))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = rows.where("asks").drop("asks").withColumn("a", part(across)).withColumn("b", every(along)).withColumn("side", F.lit(0))
    giving = rows.drop("asks").withColumn("b", part(along)).withColumn("a", every(across)).withColumn("side", F.lit(1))
    cells = asking.unionByName(giving).withColumn("cell", F.col("a") * along + F.col("b")).repartition(across * along, "cell").sortWithinPartitions("cell", "side", "id").select("cell", "side", "id", "g", "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}  # groups by number; a null group is one group
        now, asked, best = None, [], None

        def done(best: _Best | None) -> Iterator[pa.RecordBatch]:
            if best is not None:
                best.settle()
                for lo in range(0, len(best.scores), 1 << 20):
                    some, scores = best.rows[lo : lo + (1 << 20)], best.scores[lo : lo + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(best.ids[some[:, 0]]), pa.array(some[:, 1]), pa.array(scores)], ["id", "neighbour", "score"])

        for b in batches:
            cell, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if hi == lo:
                    continue
                if cell[lo] != now:
                    yield from done(best)
                    now, asked, best = cell[lo], [], None
                some = b.slice(lo, hi - lo)
                groups = np.array([names.setdefault(g, len(names)) for g in some.column(3).to_pylist()])
                held = some.column(2).to_numpy(zero_copy_only=False), groups, _vectors(some.column(4))
                if side[lo] == 0:
                    asked.append(held)
                elif asked:
                    best = best or _Best(*(np.concatenate([x[i] for x in asked]) for i in range(3)), k)
                    best.meet(*held)
        yield from done(best)

    scored = map_arrow(cells, score, "id long, neighbour long, score double")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(key), "rank", "neighbour", "score")
