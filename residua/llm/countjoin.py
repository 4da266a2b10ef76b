"""Jaccard join of shingle sets with R-trees over count vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm import words as W
from residua.llm.forest import shingle_sets, signature
from residua.operators.components import connected_components
from residua.scratch import written
from residua.ship import map_arrow

#: A region is what shares ``DEPTH`` min-hash values; every set stands in ``REGIONS`` of them.
REGIONS, DEPTH = 24, 4
#: A vector has a group for each shingle at least; trees stand over sums of so many groups. Entries of a tree's node.
COARSE, FANOUT = 8, 16
#: Points, and shingles in their sets, of either side that one task compares (or one larger set).
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: In the first pass, so many of its best neighbours are confirmed for each set.
BEST = 4


def count_vector(shingles: np.ndarray) -> bytes:
    """How many shingles each group holds, after a byte with the width of the numbers; the number of groups is the power of two from the number of shingles on, so the vector
    of half as many groups is the sum of both halves."""
    groups = 16
    while groups < len(shingles):
        groups *= 2
    counts = np.bincount((W.mix(shingles) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    wide = len(counts) and counts.max() > 255
    return (b"\4" + counts.astype("<u4").tobytes()) if wide else (b"\1" + counts.astype(np.uint8).tobytes())


def vector_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[0] == 4 else np.uint8, offset=1)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors one below the other, folded to the fewest groups that any has."""
    groups = min(map(len, vectors))
    return np.array([folded(v, groups) for v in vectors])


def coarse(vectors: np.ndarray) -> np.ndarray:
    groups = max(16, vectors.shape[1] // COARSE)
    return vectors.reshape(len(vectors), -1, groups).sum(axis=1, dtype=np.int32)


class CountTree:
    """A packed R-tree over the count vectors of sets: a node has the largest count of each group below it and the smallest size.

    The overlap of two sets is at most the sum of the smaller counts over all groups, and that of any two sets below two nodes at most
    the sum of the smaller of the nodes' counts, so pairs of nodes that cannot reach ``percent`` are left with all below them.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self.packed(vectors, sizes)
        self.most, self.least = [vectors[self.order]], [sizes[self.order]]
        while len(self.least[-1]) > 1:
            at = np.arange(0, len(self.least[-1]), FANOUT)
            self.most.append(np.maximum.reduceat(self.most[-1], at, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], at))

    @staticmethod
    def packed(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: slabs by size, slabs of those by the group that varies most, leaves by the next one."""
        n = len(sizes)
        if n <= FANOUT:
            return np.argsort(sizes, kind="stable")
        spread = np.argsort(-vectors.var(axis=0), kind="stable")
        slab = int(np.ceil((n / FANOUT) ** (1 / 3)))
        order = np.argsort(sizes, kind="stable")
        tile = np.arange(n) * slab // n
        order = order[np.lexsort((vectors[order, spread[0]], tile))]
        tile = np.arange(n) * slab * slab // n
        return order[np.lexsort((vectors[order, spread[1]], tile))]

    def leaves(self) -> list[np.ndarray]:
        return [self.order[i : i + FANOUT] for i in range(0, len(self.order), FANOUT)]

    def join(self, other: CountTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point of this tree, point of the other) that the bound leaves."""
        x, y = len(self.least) - 1, len(other.least) - 1
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            keep = reach(self.most[x], self.least[x], other.most[y], other.least[y], i, j, percent)
            i, j = i[keep], j[keep]
            if not (x or y) or not len(i):
                return self.order[i] if not x else i[:0], other.order[j] if not y else j[:0]
            # the higher tree goes down, or both
            down_x, down_y = x >= y, y >= x
            if down_x:
                x -= 1
                i, j = _children(i, j, len(self.least[x]))
            if down_y:
                y -= 1
                j, i = _children(j, i, len(other.least[y]))


def _children(nodes: np.ndarray, others: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    first = nodes * FANOUT
    n = np.minimum(first + FANOUT, below) - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(others, n)


def reach(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of rows whether the sum of the smaller counts lets two sets of these sizes be alike enough."""
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // a.shape[1])
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        both = np.minimum(a[p], b[q]).sum(axis=1, dtype=np.int64)
        out[k : k + step] = (both > 0) & ((100 + percent) * both >= percent * (a_size[p] + b_size[q]))
    return out


def segments(sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows by size, cut where the next one is so much larger that no link can reach over the gap."""
    order = np.argsort(sizes, kind="stable")
    own = sizes[order]
    return np.split(order, np.flatnonzero(100 * own[:-1] < percent * own[1:]) + 1)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        begins = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            me = tuple(c[lo] for c in cols)
            if held and me != last:
                yield pa.Table.from_batches(held)
                held = []
            last = me
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _points(some: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    ids, sizes = (some.column(c).to_numpy() for c in ("id", "size"))
    return ids, sizes, [vector_of(v) for v in some.column("vector").to_pylist()]


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in W.pieces(b.column(1)):
                n, d1, d2, sig = [], [], [], []
                for s in shingle_sets(buf, offsets, size):
                    n.append(len(s))
                    d1.append(int(W.mix(s).sum(dtype=np.uint64)))
                    d2.append(int(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    sig.append(signature(s))
                picked = np.array(sig)[:, : REGIONS * DEPTH].reshape(hi - lo, REGIONS, DEPTH)
                key = np.zeros((hi - lo, REGIONS), np.uint64)
                for d in range(DEPTH):
                    key = W.mix(key ^ picked[:, :, d]) + np.uint64(d)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * REGIONS, REGIONS), pa.int32()), pa.array(W.as_long(key.reshape(-1))))
                digests = [pa.array(W.as_long(np.array(x, np.uint64))) for x in (d1, d2)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *digests, lists], ["id", "n_shingles", "d1", "d2", "keys"])

    return run


def _vectors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in W.pieces(b.column(1)):
                sets = list(shingle_sets(buf, offsets, size))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([count_vector(s) for s in sets], pa.binary())], ["id", "size", "vector"])

    return run


def _neighbours(keys: list[str], percent: int):
    """(id, other, alike): for each point of a tree what stands next to it in packed order and its best in its leaf, if the bound leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_group(batches, keys):
            ids, sizes, vectors = _points(some)
            for rows in segments(sizes, percent):
                if len(rows) < 2:
                    continue
                own = matrix([vectors[r] for r in rows])
                tree = CountTree(coarse(own), sizes[rows])
                i, j = [tree.order[:-1]], [tree.order[1:]]
                for leaf in tree.leaves():
                    if len(leaf) > 2:
                        both = np.minimum(own[leaf][:, None], own[leaf][None]).sum(axis=2, dtype=np.int64)
                        rate = both / (sizes[rows][leaf][:, None] + sizes[rows][leaf][None] - both)
                        np.fill_diagonal(rate, -1.0)
                        i.append(leaf)
                        j.append(leaf[rate.argmax(axis=1)])
                i, j = np.concatenate(i), np.concatenate(j)
                keep = reach(own, sizes[rows], own, sizes[rows], i, j, percent)
                i, j = i[keep], j[keep]
                both = np.minimum(own[i], own[j]).sum(axis=1, dtype=np.int64)
                rate = both / (sizes[rows][i] + sizes[rows][j] - both)
                i, j = ids[rows][i], ids[rows][j]
                lo, hi = np.minimum(i, j), np.maximum(i, j)
                some_ = lo < hi
                if some_.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[some_]) for x in (lo, hi, rate)], ["lo", "hi", "alike"])

    return run


def _across(keys: list[str], percent: int, one: bool):
    """(lo, hi): pairs of an asking point and one of another component that the bound leaves, found by walking down both coarse trees at once and by the full vectors
    then. With ``one``, of an asking point's pairs with each component only the most alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_group(batches, keys):
            ids, sizes, vectors = _points(some)
            asks, comps = (some.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "component"))
            for rows in segments(sizes, percent):
                mine, theirs = rows[asks[rows]], rows[~asks[rows]]
                if not len(mine) or not len(theirs):
                    continue
                own = matrix([vectors[r] for r in rows])
                rough = coarse(own)
                at = np.zeros(len(ids), np.int64)
                at[rows] = np.arange(len(rows))
                x, y = (CountTree(rough[at[r]], sizes[r]) for r in (mine, theirs))
                i, j = x.join(y, percent)
                i, j = mine[i], theirs[j]
                keep = comps[i] != comps[j]
                i, j = i[keep], j[keep]
                keep = reach(own, sizes[rows], own, sizes[rows], at[i], at[j], percent)
                i, j = i[keep], j[keep]
                if one and len(i):
                    both = np.concatenate([np.minimum(own[at[i[k : k + 4096]]], own[at[j[k : k + 4096]]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 4096)])
                    order = np.lexsort((ids[j], -both / (sizes[i] + sizes[j] - both), comps[j], i))
                    i, j = i[order], j[order]
                    first = np.ones(len(i), bool)
                    first[1:] = (i[1:] != i[:-1]) | (comps[j[1:]] != comps[j[:-1]])
                    i, j = i[first], j[first]
                i, j = ids[i], ids[j]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["lo", "hi"])

    return run


def _confirm(size: int, percent: int):
    """(lo, hi) of the pairs of texts whose full shingle sets are alike enough."""

    def sets(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, buf, offsets in W.pieces(texts):
            yield from shingle_sets(buf, offsets, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for lo in range(0, b.num_rows, 64):
                for x, y in zip(*(sets(b.column(i).slice(lo, 64)) for i in (2, 3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["lo", "hi"]).filter(pa.array(keep, pa.bool_()))

    return run


def _grouped(rows: DataFrame, keys: list[str], run: Callable, kind: str) -> DataFrame:
    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), run, kind)


def _blocks(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """Asking rows and others of each region that holds several components, dealt to blocks (region, x, y) that hold every pair of both.

    All rows outside a region's largest component ask; the links inside a component change nothing.
    """
    rows = placed.join(comps.select("id", "component").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = written(rows, "placed")
    per = rows.groupBy("region", "component").agg(F.count("*").alias("held"), F.sum("size").alias("mass"))
    top = per.groupBy("region").agg(F.max(F.struct("held", "component", "mass")).alias("top"), F.count("*").alias("parts"), F.sum("held").alias("n"), F.sum("mass").alias("mass")).where("parts > 1")
    cut = lambda n, mass: F.greatest(F.ceil(n / BLOCK), F.ceil(mass / BLOCK_SHINGLES)).cast("int")
    top = top.select("region", F.col("top.component").alias("largest"), cut(F.col("n"), F.col("mass")).alias("ys"), cut(F.col("n") - F.col("top.held"), F.col("mass") - F.col("top.mass")).alias("xs"))
    mixed = written(rows.join(written(top, "regions").hint("merge"), "region"), "mixed")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(n[0])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[0])
    points = ["id", "size", "vector", "component"]
    whole = mixed.select("region", each("xs"), own("ys"), F.lit(False).alias("asks"), *points)
    asking = mixed.where("component <> largest").select("region", own("xs"), each("ys"), F.lit(True).alias("asks"), *points)
    return whole.unionByName(asking)


def jaccard_classes(docs: DataFrame, key: str, text: str, size: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, n_copies) for each row of ``docs``.

    Documents are linked if the distinct ``size``-word shingles of both have ``percent`` % or more of their union in common; a component's id is
    its smallest key. ``n_copies`` counts the rows with an equal set besides itself.

    Equal sets are met first, by a 128-bit digest. The shingles of every other set are hashed to groups, and the counts of the groups are a point. One tree
    over all points could not be shared out, since unrelated texts of one length are near each other in it; so each set's point
    stands in ``REGIONS`` trees, one for each region that its min-hash values name. A pair of likeness 0.85 shares none of them
    with a probability of 2e-8, a higher one less. In a region, neighbours in packed order are candidates first; then, where a region still holds several components, the
    trees of the rows outside its largest and of all its rows are joined from their roots, in blocks of bounded points: at first each row's best pair with each
    other component, then, with the components that these links leave, every pair of two of them, so nothing is
    left out but what the bound excludes. Candidates are confirmed on the full sets of both texts.

    Null or wordless texts have no shingles and stay alone; rows with a null key stay, with a null component; rows of one key
    count as one document that has all their sets; keys are integers; an empty table gives none; other columns are not looked at.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(map_arrow(own, _sign(size), "id long, n_shingles long, d1 long, d2 long, keys array<long>"), "signed")
    sets = signed.where("id is not null and n_shingles > 0")
    digest = ["n_shingles", "d1", "d2"]
    distinct = written(sets.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("keys").alias("keys")), "distinct")
    # a key with several sets links the classes of all of them
    several = sets.groupBy("id").agg(F.min(F.struct(*digest)).alias("a"), F.max(F.struct(*digest)).alias("b")).where("a <> b").select("id")
    through = sets.join(written(several, "several").hint("merge"), "id").join(distinct.select(*digest, "rep").hint("merge"), digest)
    through = through.where("id <> rep").select(F.col("rep").alias("lo"), F.col("id").alias("hi")).distinct()

    rows = distinct.select(F.col("rep").alias("id"), F.col("n_shingles").alias("mass"), F.posexplode("keys").alias("tree", "k"))
    # regions with the same rows are one
    held = rows.groupBy("tree", "k").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")).where("n > 1")
    held = held.groupBy("n", "mass", "least", "a", "b").agg(F.min(F.struct("tree", "k")).alias("at"))
    held = written(held.select("at.tree", "at.k", "n", F.col("mass").alias("all")), "regions")
    placed = rows.join(held.hint("merge"), ["tree", "k"]).select(F.xxhash64("tree", "k").alias("region"), "id", "n", "all")
    placed = written(placed, "placed")
    needed = placed.select("id").distinct()
    texts = written(own.join(needed.hint("merge"), "id"), "texts")
    points = written(map_arrow(texts, _vectors(size), "id long, size long, vector binary"), "points")
    placed = written(placed.join(points.hint("merge"), "id"), "points")

    def confirmed(some: DataFrame) -> DataFrame:
        left = some.select("lo", "hi").join(texts.select(F.col("id").alias("lo"), F.col("text").alias("x")).hint("merge"), "lo")
        both = left.join(texts.select(F.col("id").alias("hi"), F.col("text").alias("y")).hint("merge"), "hi").select("lo", "hi", "x", "y")
        return map_arrow(both, _confirm(size, percent), "lo long, hi long")

    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", "region"), parts).cast("int")).drop("n", "all")
    near = _grouped(dealt, ["region", "part"], _neighbours(["region", "part"], percent), "lo long, hi long, alike double")
    near = near.groupBy("lo", "hi").agg(F.max("alike").alias("alike"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("hi").orderBy(F.desc("alike"), "lo"))).where(F.col("rank") <= BEST)
    links = written(confirmed(written(near.select("lo", "hi"), "near")).distinct(), "links")
    block = ["region", "x", "y"]
    for one in (True, False):
        comps = connected_components(links, src="lo", dst="hi")
        left = _grouped(_blocks(placed.drop("n", "all"), comps), block, _across(block, percent, one), "lo long, hi long").distinct()
        links = written(links.unionByName(confirmed(written(left, "left"))), "links")
    comps = connected_components(links.unionByName(through), src="lo", dst="hi")

    classes = distinct.select(*digest, "rep", "rows").join(comps.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    classes = written(classes.select(*digest, "rows", F.coalesce("component", "rep").alias("component")), "classes")
    out = signed.select("id", *digest).join(classes.hint("merge"), digest, "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", comp.alias("component_id"), (F.coalesce("rows", F.lit(1)) - 1).alias("n_copies"))
