"""MinHash near-dedup with an LSH forest: several sorted signature orders, neighbours by longest common prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm import words as W
from residua.operators.components import connected_components
from residua.scratch import written
from residua.ship import map_arrow, shipped

TREES, LEAST_DEPTH, NEIGHBOURS, HASHES = 24, 4, 8, 128
#: Of 128 one-bit signature bits, a pair must agree in so many to be looked at: at a likeness of 0.8, 115 do on average with a
#: standard deviation of 3.4.
LEAST_AGREE = 97
#: Rows of a crowded region, and shingles in them, of either side, that one block of its exact comparison holds (or one longer row).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: How many values below the region's prefix a candidate must share where a region has more rows than each bound.
DEEPER = ((NEIGHBOURS + 1, 1), (64, 2), (1024, 3))
#: A region is ordered in one task up to so many rows, or up to as many as leave at most ``LISTED`` larger regions in the table.
REGION, LISTED = 1024, 100_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its ``size``-word shingles, A-Z in lower case; of fewer words,
    the whole sequence is one shingle; without words, none."""
    w = W.words(W.lower_ascii(buf), offsets)
    n = len(w.hashes)
    at = np.arange(max(0, n - size + 1))
    rolled = W.word_runs(w)
    grams = rolled.runs(at, at + size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield rolled.runs(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions, upper 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[i : i + 1024, None] * _A + _B).min(axis=0))
    return low >> np.uint64(32)


def _tree_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree, of many signatures: a hash of the first LEAST_DEPTH values, and the next four as a sort key."""
    u = np.uint64
    picked = sig[:, : TREES * LEAST_DEPTH].reshape(len(sig), TREES, LEAST_DEPTH)
    key = np.zeros((len(sig), TREES), u)
    for d in range(LEAST_DEPTH):
        key = W.mix(key ^ picked[:, :, d]) + u(d)
    deeper = np.roll(picked, -1, axis=1)
    tail = np.zeros((len(sig), TREES), u)
    for d in range(4):
        tail = (tail << u(16)) | (deeper[:, :, d % LEAST_DEPTH] >> u(16))
    return key, tail


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
                sig = np.array(sig)
                key, tail = _tree_keys(sig)
                bits = np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * TREES, TREES), pa.int32()), pa.array(W.as_long(x.reshape(-1)))) for x in (key, tail)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(W.as_long(np.array(d1, np.uint64))), pa.array(W.as_long(np.array(d2, np.uint64))), *lists, pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1]))],
                    ["id", "n_shingles", "d1", "d2", "keys", "tails", "b1", "b2"],
                )

    return run


def _confirm(size: int, percent: int):
    """(lo, hi) of the pairs of texts whose full shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for lo in range(0, b.num_rows, 64):
                left, right = ([*_sets(b.column(i).slice(lo, 64), size)] for i in (2, 3))
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["lo", "hi"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, buf, offsets in W.pieces(texts):
        yield from shingle_sets(buf, offsets, size)


def alike_pairs(sets: list[np.ndarray], asks: np.ndarray, comps: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row, the other rows of other components whose set is alike enough.

    Shingles are ranked from the rarest among all rows of the block to the most frequent. Two sets with ``percent`` % of their union in common share a shingle
    among the first n - ceil(percent n / 100) + 1 of either, so only rows that meet there are counted in full: rows that merely have
    the same frequent shingles never meet.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(held), np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(len(held))
    row = np.repeat(np.arange(len(sets)), lengths)
    ranks = place[at]
    ranks = ranks[np.lexsort((ranks, row))]
    starts = np.cumsum(lengths) - lengths
    first = lengths - -(-percent * lengths // 100) + 1
    early = np.flatnonzero((np.arange(len(ranks)) - starts[row] < first[row]) & ~asks[row])
    early = early[np.argsort(ranks[early], kind="stable")]
    index, owner = ranks[early], row[early]
    mark = np.zeros(len(held), bool)
    for i in np.flatnonzero(asks).tolist():
        mine = ranks[starts[i] : starts[i] + lengths[i]]
        lo, hi = (np.searchsorted(index, mine[: first[i]], side) for side in ("left", "right"))
        met = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a] or [owner[:0]]))
        met = met[(comps[met] != comps[i]) & (100 * np.minimum(lengths[met], lengths[i]) >= percent * np.maximum(lengths[met], lengths[i]))]
        mark[mine] = True
        both = np.array([np.count_nonzero(mark[ranks[starts[j] : starts[j] + lengths[j]]]) for j in met.tolist()], np.int64)
        mark[mine] = False
        yield i, met[100 * both >= percent * (lengths[met] + lengths[i] - both)]


def _link_block(size: int, percent: int):
    """(lo, hi) of links between the asking rows of a block and its other rows, one for each component that a row meets."""

    def run(block: pa.Table) -> pa.Table:
        asks, ids, comps = (block.column(c).to_numpy() for c in ("asks", "id", "component"))
        links = []
        if asks.any() and not asks.all():
            sets = [s for chunk in block.column("text").chunks for s in _sets(chunk, size)]
            for i, alike in alike_pairs(sets, asks, comps, percent):
                _, one = np.unique(comps[alike], return_index=True)
                links += [(int(min(ids[i], y)), int(max(ids[i], y))) for y in ids[alike][one].tolist()]
        return pa.table({"lo": pa.array([x for x, _ in links], pa.int64()), "hi": pa.array([y for _, y in links], pa.int64())})

    return run


def _apart(crowded: DataFrame, comps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(lo, hi): the links in crowded regions between different components, near in the order or not.

    Of a region's components, all rows but those of the largest are asked against the whole region, on full sets. Both
    sides are cut into blocks by a hash, so that a task holds ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles or so of either side, and only links leave it.
    """
    rows = crowded.join(comps.select("id", "component").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = written(rows.select("tree", "k", "n", "id", "size", "component"), "crowded")
    per = rows.groupBy("tree", "k", "n", "component").agg(F.count("*").alias("held"), F.sum("size").alias("mass"))
    top = per.groupBy("tree", "k").agg(F.max(F.struct("held", "component", "mass")).alias("top"), F.count("*").alias("parts"), F.max("n").alias("n"), F.sum("mass").alias("mass")).where("parts > 1")
    cut = lambda n, mass: F.greatest(F.ceil(n / BLOCK), F.ceil(mass / BLOCK_SHINGLES)).cast("int")
    top = top.select("tree", "k", F.col("top.component").alias("most"), cut(F.col("n"), F.col("mass")).alias("ys"), cut(F.col("n") - F.col("top.held"), F.col("mass") - F.col("top.mass")).alias("xs"), "n")
    # a region's rows know how many they are, so they are dealt to as many salts as they need and meet one copy of the region's row at each
    salts = F.ceil(F.col("n") / REGION).cast("int")
    top = written(top.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), "regions")
    mixed = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(top.hint("merge"), ["tree", "k", "salt"])
    mixed = written(mixed.select("tree", "k", "id", "component", (F.col("component") != F.col("most")).alias("asks"), "ys", "xs"), "mixed")
    mixed = written(mixed.join(texts.hint("merge"), "id"), "mixed")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(n[0])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[0])
    whole = mixed.select("tree", "k", each("xs"), own("ys"), F.lit(False).alias("asks"), "id", "component", "text")
    asking = mixed.where("asks").select("tree", "k", own("xs"), each("ys"), "asks", "id", "component", "text")
    shipped(crowded.sparkSession)
    return whole.unionByName(asking).groupBy("tree", "k", "x", "y").applyInArrow(_link_block(size, percent), "lo long, hi long").distinct()


def _common(x: Column, y: Column) -> Column:
    """How many of the four values of two tails agree before the first that differs."""
    apart = x.bitwiseXOR(y)
    return sum((F.shiftrightunsigned(apart, 16 * d) == 0).cast("int") for d in range(4))


def _with_parts(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``n``, the rows of their region if those are more than one task should order, else null, and ``part``, the part of it that each row stands in.

    Each tree deals its rows anew, so that the parts of one tree meet in others. The limit rises with ``total``, the number of all rows, so that at most ``LISTED`` regions can be above it, which bounds what is broadcast.
    """
    limit = max(REGION, -(-total // LISTED))
    large = written(rows.groupBy("tree", "k").agg(F.count("*").alias("n")).where(F.col("n") > limit), "large")
    large = large.select(F.col("tree").alias("_tree"), F.col("k").alias("_k"), "n")
    both = rows.join(F.broadcast(large), (F.col("tree") == F.col("_tree")) & (F.col("k") == F.col("_k")), "left").drop("_tree", "_k")
    return both.withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / limit))).cast("int"))


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = 2, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if the distinct ``size``-word shingles of both have ``percent`` % or more of their union in
    common; a component's id is its smallest key, which is the one that is kept.

    Equal shingle sets are met first, by a 128-bit digest, so that thousands of copies cost one row. The rest stand in
    ``TREES`` orders, each sorted by its own sequence of min-hash values; rows that share the first ``LEAST_DEPTH`` values
    are a region, and in it each row's nearest ``NEIGHBOURS`` in the order, which have the longest prefixes in common with it,
    are candidates if that prefix is as long as the region asks: ``LEAST_DEPTH`` values in a sparse region, up to three more the denser it is (``DEEPER``).
    A pair of likeness 0.8 shares a region in at least one tree with a probability of 0.999997. In regions of more rows,
    what is farther apart in the order, or agrees less deeply, but still in different components is compared in blocks, on full sets, behind an exact prefix filter. A region of very many
    rows is ordered in parts, which that comparison joins. Candidates
    must agree in ``LEAST_AGREE`` of 128 signature bits; links are confirmed on the full sets of both texts, first
    each document's best candidate, then those that would still join two components, since a link inside a component
    changes nothing. Null or wordless texts have no shingles and stay alone; rows with a null key stay, with a null
    component; rows of one key count as one document that has all their sets, so whatever one of them links to is linked to all; keys
    are integers (others raise where they do not read as such); empty tables work; other columns are not looked at.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    kind = "id long, n_shingles long, d1 long, d2 long, keys array<long>, tails array<long>, b1 long, b2 long"
    signed = written(map_arrow(own, _sign(size), kind), "signed")
    sets = signed.where("id is not null and n_shingles > 0")
    distinct = sets.groupBy("n_shingles", "d1", "d2").agg(
        F.min("id").alias("rep"), F.first("keys").alias("keys"), F.first("tails").alias("tails"), F.first("b1").alias("b1"), F.first("b2").alias("b2")
    )
    distinct = written(distinct, "distinct")
    # a key with several sets links the classes of all of them
    digest = F.struct("d1", "d2", "n_shingles")
    several = written(sets.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("id"), "several")
    through = sets.join(several.hint("merge"), "id").join(distinct.select("n_shingles", "d1", "d2", "rep").hint("merge"), ["n_shingles", "d1", "d2"])
    through = through.where("id <> rep").select(F.col("rep").alias("lo"), F.col("id").alias("hi")).distinct()
    rows = distinct.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), "b1", "b2", F.posexplode(F.arrays_zip("keys", "tails")).alias("tree", "at"))
    rows = _with_parts(rows.select("id", "size", "b1", "b2", "tree", F.col("at.keys").alias("k"), F.col("at.tails").alias("tail")), TREES * distinct.count())
    region = Window.partitionBy("tree", "k", "part")
    order = region.orderBy("tail", "id")
    me = F.struct("id", "b1", "b2", "tail")
    nexts = F.array(*[F.lead(me, i).over(order) for i in range(1, NEIGHBOURS + 1)]).alias("next")
    beside = rows.select("id", "size", "b1", "b2", "tree", "k", "tail", nexts, F.coalesce("n", F.count("*").over(region)).alias("n"))
    agree = lambda z: 128 - F.bit_count(z["b1"].bitwiseXOR(F.col("b1"))) - F.bit_count(z["b2"].bitwiseXOR(F.col("b2")))
    depth = F.lit(0)
    for rows_above, values in DEEPER:
        depth = F.when(F.col("n") > rows_above, values).otherwise(depth)
    beside = beside.withColumn("depth", depth)
    deep = F.filter("next", lambda z: _common(z["tail"], F.col("tail")) >= F.col("depth"))
    near = F.filter(F.transform(deep, lambda z: F.struct(z["id"].alias("id"), agree(z).alias("agree"))), lambda z: z["agree"] >= LEAST_AGREE)
    beside = beside.select("id", "size", "tree", "k", "n", near.alias("near")).where((F.size("near") > 0) | (F.col("n") > NEIGHBOURS + 1))
    beside = written(beside, "beside")
    pairs = beside.select("id", F.explode("near").alias("z")).where("id <> z.id")
    pairs = pairs.select(F.least("id", "z.id").alias("lo"), F.greatest("id", "z.id").alias("hi"), F.col("z.agree").alias("agree"))
    pairs = written(pairs.groupBy("lo", "hi").agg(F.max("agree").alias("agree")), "pairs")
    crowded = beside.where(F.col("n") > NEIGHBOURS + 1).drop("near")

    needed = pairs.select(F.col("lo").alias("id")).unionByName(pairs.select(F.col("hi").alias("id"))).unionByName(crowded.select("id")).distinct()
    texts = written(own.join(needed.hint("merge"), "id"), "texts")

    def confirmed(some: DataFrame) -> DataFrame:
        left = some.select("lo", "hi").join(texts.select(F.col("id").alias("lo"), F.col("text").alias("x")).hint("merge"), "lo")
        both = left.join(texts.select(F.col("id").alias("hi"), F.col("text").alias("y")).hint("merge"), "hi").select("lo", "hi", "x", "y")
        return map_arrow(both, _confirm(size, percent), "lo long, hi long")

    best = pairs.groupBy("hi").agg(F.max_by("lo", F.struct("agree", -F.col("lo"))).alias("lo"))
    links = written(confirmed(best).distinct(), "links")
    first = connected_components(links, src="lo", dst="hi")
    left = pairs.join(best.hint("merge"), ["lo", "hi"], "left_anti")
    for end in ("lo", "hi"):
        comp = first.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
        left = left.join(comp.hint("merge"), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    more = confirmed(written(left.where("c_lo <> c_hi").select("lo", "hi"), "open"))
    rest = _apart(crowded, first, texts, size, percent)
    links = written(links.unionByName(more).unionByName(rest).unionByName(through), "links")
    comps = connected_components(links, src="lo", dst="hi")

    classes = distinct.select("n_shingles", "d1", "d2", "rep").join(comps.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    classes = written(classes.select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component")), "classes")
    out = signed.select("id", "n_shingles", "d1", "d2").join(classes.hint("merge"), ["n_shingles", "d1", "d2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
