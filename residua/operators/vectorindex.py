"""Approximate nearest neighbours: inverted-file cells with product-quantised residuals, exact scores for what they find."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.scratch import written
from residua.ship import map_arrow

#: The index is fitted on so many rows at most, those with the least hashes of their keys; it has so many cells and codewords at most.
SAMPLE, MOST_CELLS, CODEWORDS = 20_000, 4096, 256
#: Neighbouring cells are one shard until they hold so many rows, since each query sends on its candidates from each; rows of a shard, and queries, that one task compares.
SHARD, ROWS, QUERIES = 8192, 65_536, 1_000_000
#: So many rows of the sample measure the recall.
MEASURED = 256


class Index(NamedTuple):
    """Cells, the codewords of each stretch of the residuals, and how many cells and candidates reach the recall that was asked for on the sample."""

    cells: np.ndarray
    codebooks: np.ndarray  # stretch, codeword, dimension
    probes: int
    candidates: int
    recall: float


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random rows; a cell that loses all its rows stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]])


def encode(x: np.ndarray, cell: np.ndarray, index: Index) -> np.ndarray:
    parts = np.split(x - index.cells[cell], len(index.codebooks), axis=1)
    return np.stack([nearest(p, c) for p, c in zip(parts, index.codebooks, strict=True)], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, cell: np.ndarray, index: Index) -> np.ndarray:
    return index.cells[cell] + np.concatenate([c[codes[:, s]] for s, c in enumerate(index.codebooks)], axis=1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def fit(df: DataFrame, key: str, group: str, vec: str, k: int = 32, recall: float = 0.95, stretches: int | None = None, seed: int = 7) -> Index:
    """An index of the dot product for ``search``. Cells and codewords are trained on a bounded sample (``SAMPLE`` rows); on ``MEASURED`` of its
    rows, against all of it, the fewest cells to look into and the fewest candidates to score are found that reach ``recall``, with a margin."""
    known = df.where(F.col(vec).isNotNull() & F.col(key).isNotNull())
    total = known.count()
    rows = known.select(F.xxhash64(key).alias("h"), F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("v")).orderBy("h", "id").limit(SAMPLE).collect()
    if not rows:
        return Index(np.zeros((1, 1)), np.zeros((1, 1, 1)), 1, 1, 1.0)
    rng = np.random.default_rng(seed)
    x, groups = np.array([r["v"] for r in rows]), np.array([r["g"] for r in rows], object)
    dim = x.shape[1]
    cells = k_means(x, int(min(MOST_CELLS, max(1, total**0.5))), 8, rng)
    cell = nearest(x, cells)
    parts = stretches or next(s for s in range(max(1, dim // 4), 0, -1) if dim % s == 0)
    books = [k_means(p, CODEWORDS, 8, rng) for p in np.split(x - cells[cell], parts, axis=1)]
    index = Index(cells, np.stack(books), 1, k, 0.0)
    asked = rng.choice(len(x), min(MEASURED, len(x)), replace=False)
    apart = groups[asked][:, None] != groups[None, :]
    exact = np.where(apart, x[asked] @ x.T, -np.inf)
    top = _best(exact, k)
    true = np.isfinite(np.take_along_axis(exact, top, 1))
    # of each true neighbour, how many cells must be looked into for it
    order = np.argsort(np.argsort(-(x[asked] @ cells.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(order, cell[top], 1)[true]) + 1
    aim = recall + (1 - recall) / 2
    probes = int(needed[min(len(needed) - 1, int(aim * len(needed)))]) if len(needed) else 1
    about = np.where(apart & (order[:, cell] < probes), x[asked] @ decode(encode(x, cell, index), cell, index).T, -np.inf)
    place = np.argsort(np.argsort(-about, axis=1, kind="stable"), axis=1)
    ranks = np.where(np.isfinite(np.take_along_axis(about, top, 1)), np.take_along_axis(place, top, 1), len(x))[true]
    candidates = k
    while candidates < len(x) and len(ranks) and (ranks < candidates).mean() < recall + (1 - recall) / 4:
        candidates *= 2
    return index._replace(probes=probes, candidates=candidates, recall=float((ranks < candidates).mean()) if len(ranks) else 1.0)


def _assigned(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1)
                cell = nearest(x, own.cells)
                codes = encode(x, cell, own)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "g", "cell", "codes"])

    return run


def _probed(index, shards: np.ndarray):
    """Each query with the shards of its best cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1)
                lists = [np.unique(shards[row]).tolist() for row in _best(x @ own.cells.T, own.probes)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], ["id", "g", "v", "shards"])

    return run


def _scored(index):
    """The best candidates of each query in each part of a shard. Codes stand before queries, so only the codes of one part are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        at, codes, held = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)  # shard, part, block, side
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                here, side, some = tuple(keys[lo, :3]), keys[lo, 3], b.slice(lo, hi - lo)
                if here != at:
                    at, codes, held = here, [], None
                ids, groups = some.column(4).to_numpy(zero_copy_only=False), np.array(some.column(5).to_pylist(), object)
                if side == 0:
                    codes.append((ids, groups, np.array([np.frombuffer(c, np.uint8) for c in some.column(6).to_pylist()]), some.column(7).to_numpy(zero_copy_only=False).astype(np.int64)))
                    continue
                if not codes:
                    continue
                if held is None:
                    ids_, groups_, codes_, cells_ = (np.concatenate([c[n] for c in codes]) for n in range(4))
                    held = ids_, groups_, decode(codes_, cells_, own)
                x = np.asarray(some.column(8).flatten(), np.float64).reshape(hi - lo, -1)
                for i in range(0, hi - lo, 256):
                    scores = x[i : i + 256] @ held[2].T
                    scores[groups[i : i + 256, None] == held[1][None, :]] = -np.inf
                    order = _best(scores, own.candidates)
                    best = np.take_along_axis(scores, order, 1)
                    q, j = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + q]), pa.array(held[0][order[q, j]]), pa.array(best[q, j])], ["id", "neighbour", "about"])

    return run


def search(df: DataFrame, key: str, group: str, vec: str, index: Index, k: int = 32, queries: Column | None = None) -> DataFrame:
    """(key, rank, neighbour, score): the ``k`` rows of another group with the highest dot product for each row, or for those that ``queries`` picks.

    Every row is indexed: it stands in its nearest cell as the codewords of what its cell's centre leaves. A query looks into the
    index's ``probes`` best cells; the ``candidates`` best by the codewords are scored exactly. Small cells share a shard, which is scored as a whole, large ones are cut into parts of
    ``ROWS`` rows, many queries into blocks, and a task holds the codes of one part. Null vectors and keys are left out; null groups are one group; ties go to the smaller neighbour; an empty table gives none.
    """
    spark = df.sparkSession
    own = df.select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("v"), (F.lit(True) if queries is None else queries).alias("asks")).where("id is not null and v is not null")
    asks = own.where("asks").select("id", "g", "v")
    sent = spark.sparkContext.broadcast(index)
    coded = written(map_arrow(own.select("id", "g", "v"), _assigned(sent), "id long, g string, cell int, codes binary"), "coded")
    blocks = max(1, -(-asks.count() // QUERIES))
    counts = np.zeros(len(index.cells), np.int64)
    for r in coded.groupBy("cell").count().collect():  # one row for each cell, MOST_CELLS at most
        counts[r["cell"]] = r["count"]
    shards, held_rows = np.zeros(len(counts), np.int32), [0]
    for c, n in enumerate(counts.tolist()):
        if held_rows[-1] + n > SHARD and held_rows[-1]:
            held_rows.append(0)
        shards[c] = len(held_rows) - 1
        held_rows[-1] += n
    dealt = spark.createDataFrame([(c, int(s), -(-held_rows[s] // ROWS) or 1) for c, s in enumerate(shards.tolist())], "cell int, shard int, parts int")
    parts = F.broadcast(dealt.select("shard", "parts").distinct())
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none, vector = F.lit(None).cast("array<double>").alias("v"), [F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("int").alias("cell")]
    held = coded.join(F.broadcast(dealt), "cell").select("shard", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), each(F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "id", "g", "codes", "cell", none)
    probed = map_arrow(asks, _probed(sent, shards), "id long, g string, v array<double>, shards array<int>").withColumn("shard", F.explode("shards")).join(parts, "shard")
    probed = probed.select("shard", each(F.col("parts")).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "id", "g", *vector, "v")
    both = held.unionByName(probed).repartition("shard", "part", "block").sortWithinPartitions("shard", "part", "block", "side")
    found = map_arrow(both, _scored(sent), "id long, neighbour long, about double")
    near = Window.partitionBy("id").orderBy(F.desc("about"), "neighbour")
    found = written(found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= index.candidates).select("id", "neighbour"), "found")
    vectors = written(own.select("id", "v"), "vectors")
    met = found.join(vectors.select(F.col("id").alias("neighbour"), F.col("v").alias("w")).hint("merge"), "neighbour").join(vectors.hint("merge"), "id")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    scored = met.select("id", "neighbour", F.round(dot, 6).alias("score")).distinct().withColumn("rank", F.row_number().over(w))
    return scored.where(F.col("rank") <= k).select(F.col("id").alias(key), "rank", "neighbour", "score")
