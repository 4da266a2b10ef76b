"""Connected components of an edge table: a forest in each task first, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.scratch import written
from residua.ship import map_arrow

#: Edges that one task contracts to a forest.
EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node that is not the root, the smallest, of its component among these edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    below = np.flatnonzero(root < np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _contract(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges as forests of ``tasks`` tasks with the same components; with one task, every node points to the smallest of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            kind = some[0].schema.field(0).type
            u, v = forest(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "u", "v")
    return map_arrow(dealt, run, ", ".join(f"{n} {t}" for n, t in edges.dtypes))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles and a hub's rows can be split over tasks
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. Every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", id_col: str = "id") -> DataFrame:
    """(id, component): the smallest id that each id reaches, in the order of the ids' own type.

    Edges are undirected; nulls, self-loops and repeated edges are ignored. Ids without edges appear only if
    ``nodes`` (one column ``id_col``) lists them, each as its own component.

    Edges are dealt to tasks of ``EDGES``, which send on a forest each: a node points to the smallest one that it reaches there, so a dense part
    is no larger than its nodes. What one task holds is done then; otherwise the forests are contracted in rounds until the edge table no
    longer changes. Each round is written to the shared scratch folder, nothing is collected but two numbers.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    tasks = -(-e.count() // EDGES)
    if tasks:
        e = written(_contract(e, tasks), "edges")
    before = None
    while tasks > 1:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = written(_small_star(_large_star(e)), "edges")
    found = e.select(F.col("u").alias(id_col), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias(id_col)).distinct().withColumn("component", F.col(id_col))
    found = found.unionByName(roots)
    if nodes is None:
        return found
    every = nodes.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return every.join(found.hint("merge"), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("component"))
