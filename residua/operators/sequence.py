"""Alignment of candidate pairs, mappings from gapped strings, conformer choice, near-duplicate sequences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.scratch import beside, written
from residua.ship import map_arrow


#: So many cells of a stretch of rows have their choices written down at once; longer stretches are cut into ``PARTS``.
CELLS, PARTS = 1 << 22, 8
_DIAGONAL, _DOWN, _DOWN_ENDS, _RIGHT_ENDS = 1, 2, 4, 8


def align(a: str, b: str, match: float = 2.0, mismatch: float = -1.0, first: float = -2.0, more: float = -0.5) -> tuple[float, str, str]:
    """Global alignment with affine gaps, ends included: a gap of L costs first + (L - 1) more.

    Ties: diagonal, then a gap in the second string, then a gap in the first. Rows are computed with numpy; the gap along a row is
    a running maximum, since its cost is linear in the length.

    Divide and conquer in linear space: a stretch of rows keeps the scores of ``PARTS`` of its rows, and the parts are walked from the last to the
    first, each cut again until its choices fit ``CELLS`` bytes. A part is computed anew only up to the column that the walk has reached, so the
    whole costs about twice the scores alone, and no more than some rows of scores are held.
    """
    n, m = len(a), len(b)
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    j = np.arange(m + 1)
    out_a, out_b = [], []
    top = np.concatenate([[0.0], first + more * np.arange(m)])

    def step(i: int, best: np.ndarray, down: np.ndarray, choices: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Row i from the one above it, in as many columns; and what the walk may choose in each."""
        k = len(best)
        below = np.maximum(best + first, down + more)
        open_ = below.copy()
        diagonal = best[:-1] + np.where(x[i - 1] == y[: k - 1], match, mismatch)
        np.maximum(open_[1:], diagonal, out=open_[1:])
        # opening after another right gap never pays, so the scan runs over the other two states
        right = np.maximum.accumulate(open_ - more * j[:k])[:-1] + first + more * (j[1:k] - 1)
        now = open_.copy()
        np.maximum(now[1:], right, out=now[1:])
        if not choices:
            return now, below, None
        may = _DOWN * (np.abs(now - below) < 1e-9) + _DOWN_ENDS * (np.abs(below - best - first) < 1e-9)
        may[1:] += _DIAGONAL * (now[1:] == diagonal) + _RIGHT_ENDS * (np.abs(right - now[:-1] - first) < 1e-9)
        return now, below, may.astype(np.uint8)

    def walk(lo: int, hi: int, best: np.ndarray, down: np.ndarray, k: int, state: str) -> tuple[int, str, float]:
        """From row hi and column k up to row lo, whose scores are given; also the score where the walk begins."""
        best, down = best[: k + 1], down[: k + 1]
        if (hi - lo) * (k + 1) > CELLS and hi - lo > 1:
            cuts = np.unique(np.linspace(lo, hi, PARTS + 1).astype(int)).tolist()
            held = [(best, down)]
            for c, d in zip(cuts[:-2], cuts[1:-1], strict=True):
                for i in range(c + 1, d + 1):
                    best, down, _ = step(i, best, down, False)
                held.append((best, down))
            score = None
            for c, d, rows in reversed(list(zip(cuts[:-1], cuts[1:], held, strict=True))):
                k, state, end = walk(c, d, *rows, k, state)
                score = end if score is None else score
            return k, state, score
        choices = []
        for i in range(lo + 1, hi + 1):
            best, down, may = step(i, best, down, True)
            choices.append(may)
        score, i = float(best[k]), hi
        while i > lo:
            may = choices[i - lo - 1][k]
            if state == "best":
                if may & _DIAGONAL:
                    i, k = i - 1, k - 1
                    out_a.append(a[i])
                    out_b.append(b[k])
                    continue
                state = "down" if may & _DOWN else "right"
            if state == "down":
                i -= 1
                out_a.append(a[i])
                out_b.append("-")
                ends = may & _DOWN_ENDS
            else:
                k -= 1
                out_a.append("-")
                out_b.append(b[k])
                ends = may & _RIGHT_ENDS
            if ends:
                state = "best"
        return k, state, score

    k, _, score = walk(0, n, top, np.full(m + 1, -1e18), m, "best") if n else (m, "best", float(top[m]))
    return score, "-" * k + "".join(reversed(out_a)), b[:k] + "".join(reversed(out_b))


def align_pairs(df: DataFrame, a: str, b: str, **costs: float) -> DataFrame:
    """``df`` with score, gapped_a and gapped_b; equal pairs of strings are aligned once in each batch. Null strings are empty."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            pairs = list(zip(batch.column(names.index(a)).to_pylist(), batch.column(names.index(b)).to_pylist(), strict=True))
            for p in pairs:
                if p not in known:
                    known[p] = align(p[0] or "", p[1] or "", **costs)
            cols = [pa.array([known[p][i] for p in pairs], t) for i, t in ((0, pa.float64()), (1, pa.string()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "score", "gapped_a", "gapped_b"])

    kind = ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], "score double", "gapped_a string", "gapped_b string"])
    return map_arrow(df, run, kind)


def alignment_mapping(df: DataFrame, key: str, gapped_a: str, gapped_b: str, edge: int = 2) -> DataFrame:
    """(key, col, index_a, index_b, kind) of each column of an alignment; indexes count from 0 and are null at gaps.

    The kind is match, protein_edge (a match among the first or last ``edge`` of either string), mismatch,
    gap_in_structure (gap in the first string) or gap_in_cs. Pure column expressions; an alignment is one window.
    """
    chars = F.arrays_zip(F.split(F.col(gapped_a), "").alias("a"), F.split(F.col(gapped_b), "").alias("b"))
    rows = df.select(key, F.posexplode(chars).alias("col", "z")).select(key, "col", F.col("z.a").alias("a"), F.col("z.b").alias("b")).where("a <> '' and b <> ''")
    w = Window.partitionBy(key).orderBy("col")
    every = Window.partitionBy(key)
    seen: dict[str, Column] = {}
    for s in "ab":
        has = (F.col(s) != "-").cast("int")
        seen[f"i_{s}"] = F.sum(has).over(w) - 1
        seen[f"n_{s}"] = F.sum(has).over(every)
    rows = rows.withColumns(seen)
    near = [F.col(f"i_{s}") < edge for s in "ab"] + [F.col(f"i_{s}") >= F.col(f"n_{s}") - edge for s in "ab"]
    kind = (
        F.when(F.col("a") == "-", "gap_in_structure").when(F.col("b") == "-", "gap_in_cs").when(F.col("a") != F.col("b"), "mismatch").when(near[0] | near[1] | near[2] | near[3], "protein_edge").otherwise("match")
    )
    return rows.select(key, "col", F.when(F.col("a") != "-", F.col("i_a")).alias("index_a"), F.when(F.col("b") != "-", F.col("i_b")).alias("index_b"), kind.alias("kind"))


#: The upper half of a symmetric 4 x 4 matrix, row by row, and how often it is squared: the exponent of the power iteration is 2 to that.
_UPPER = [(i, j) for i in range(4) for j in range(i, 4)]
SQUARINGS = 40


def _entry(m: Column, i: int, j: int) -> Column:
    return m[_UPPER.index((min(i, j), max(i, j)))]


def _scaled(m: Column) -> Column:
    """With a trace of 1; null for a matrix of zeros."""
    trace = lambda z: z[0] + z[4] + z[7] + z[9]
    return F.transform(m, lambda v: v / F.when(trace(m) > 0, trace(m)))


def _squared(m: Column) -> Column:
    products = F.array(*[sum((_entry(m, i, k) * _entry(m, k, j) for k in range(1, 4)), _entry(m, i, 0) * _entry(m, 0, j)) for i, j in _UPPER])
    return F.transform(F.array(products), _scaled)[0]


def superposition(points: DataFrame, keys: list[str], mobile: list[str], target: list[str]) -> DataFrame:
    """(keys, centre, goal, turn) of each group: the rotation ``turn``, 9 numbers row by row, that brings its mobile points closest to the targets in least
    squares, about the mobile points' ``centre``, which goes to ``goal``.

    One aggregation gives the covariances; the best rotation's quaternion is the eigenvector with the largest eigenvalue of a symmetric 4 x 4 matrix of their sums
    and differences. The matrix is shifted to have none below 0 and squared ``SQUARINGS`` times in columns, which leaves
    the projection on that eigenvector; where several rotations are equally good, one of them. Points that all coincide are not turned.
    """
    names = [f"{a}{b}" for a in "xyz" for b in "xyz"]
    cov = [F.covar_pop(F.col(mobile[i // 3]), F.col(target[i % 3])).alias(f"_{n}") for i, n in enumerate(names)]
    spread = sum((F.var_pop(F.col(c)) for c in [*mobile[1:], *target]), F.var_pop(F.col(mobile[0])))
    means = [F.array(*[F.avg(F.col(c)) for c in some]).alias(n) for n, some in (("centre", mobile), ("goal", target))]
    own = points.groupBy(*keys).agg(*cov, (spread / 2).alias("_shift"), *means)
    s = {n: F.col(f"_{n}") for n in names}
    diagonal = [s["xx"] + s["yy"] + s["zz"], s["xx"] - s["yy"] - s["zz"], s["yy"] - s["xx"] - s["zz"], s["zz"] - s["xx"] - s["yy"]]
    others = {(0, 1): s["yz"] - s["zy"], (0, 2): s["zx"] - s["xz"], (0, 3): s["xy"] - s["yx"], (1, 2): s["xy"] + s["yx"], (1, 3): s["zx"] + s["xz"], (2, 3): s["yz"] + s["zy"]}
    matrix = F.array(*[diagonal[i] + F.col("_shift") if i == j else others[i, j] for i, j in _UPPER])
    power = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), F.transform(F.array(matrix), _scaled)[0], lambda m, _: _squared(m))
    own = own.withColumn("_power", power)
    # the projection's column with the largest diagonal entry is the eigenvector
    best = F.greatest(*[_entry(F.col("_power"), i, i) for i in range(4)])
    picked = F.when(best.isNull(), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)]))
    for i in range(4):
        column = [_entry(F.col("_power"), i, k) for k in range(4)]
        length = F.sqrt(sum((v * v for v in column[1:]), column[0] * column[0]))
        picked = picked.when(_entry(F.col("_power"), i, i) == best, F.array(*[v / length for v in column]))
    own = own.withColumn("_q", picked)
    w, x, y, z = (F.col("_q")[i] for i in range(4))
    turn = F.array(
        w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z
    )
    return own.select(*keys, "centre", "goal", turn.alias("turn"))


def best_conformer(points: DataFrame, entry: str, model: str, pos: str, xyz: list[str], least: int = 10) -> DataFrame:
    """(entry, model, rmsd): the model nearest to the median of all, after each is laid over the first.

    Models are compared on the positions that all have with all coordinates; fewer than ``least`` give the first model and a null rmsd. Entry, model and position name
    one row. All of it is SQL: covariances, rotations, medians and distances; an entry of any size is spread over the tasks.
    """
    p = points.select(F.col(entry).alias("e"), F.col(model).alias("m"), F.col(pos).alias("p"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(xyz)])
    first = written(p.groupBy("e").agg(F.min("m").alias("m1"), F.count_distinct("m").alias("k")), "first")
    p = p.where(" and ".join(f"c{i} is not null" for i in range(3)))
    common = p.groupBy("e", "p").agg(F.count_distinct("m").alias("n")).join(first.hint("merge"), "e").where("n = k").select("e", "p", "m1")
    common = written(common, "common")
    enough = common.groupBy("e").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("e")
    common = common.join(written(enough, "enough").hint("merge"), "e", "left_semi")
    used = written(p.join(common.hint("merge"), ["e", "p"]), "used")
    base = used.where("m = m1").select("e", "p", *[F.col(f"c{i}").alias(f"t{i}") for i in range(3)])
    both = used.join(base.hint("merge"), ["e", "p"])
    turns = written(superposition(both, ["e", "m"], ["c0", "c1", "c2"], ["t0", "t1", "t2"]), "turns")
    moved = used.join(turns.hint("merge"), ["e", "m"])
    off = [F.col(f"c{i}") - F.col("centre")[i] for i in range(3)]
    laid = moved.select("e", "m", "p", *[(F.col("turn")[3 * r] * off[0] + F.col("turn")[3 * r + 1] * off[1] + F.col("turn")[3 * r + 2] * off[2] + F.col("goal")[r]).alias(c) for r, c in enumerate("xyz")])
    laid = written(laid, "laid")
    middle = laid.groupBy("e", "p").agg(*[F.percentile(c, 0.5).alias(f"q{c}") for c in "xyz"])
    away = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    rmsd = laid.join(middle.hint("merge"), ["e", "p"]).groupBy("e", "m").agg(F.sqrt(F.avg(away)).alias("rmsd"))
    best = rmsd.groupBy("e").agg(F.min_by("m", F.struct(F.round("rmsd", 9), "m")).alias("b"), F.min("rmsd").alias("rmsd"))
    return first.join(best.hint("merge"), "e", "left").select(F.col("e").alias(entry), F.coalesce("b", "m1").alias(model), "rmsd")


#: Shingles are counted in about so many documents, and so many of the most frequent go to the end of the order; how they are picked changes the work, never the pairs.
COUNTED, FREQUENT = 100_000, 200_000
#: One in so many of a set's shingles is asked for beyond the first that a pair must share.
SHARED = 50
#: Up to so many ids of candidates pick their sets by a broadcast.
CANDIDATES = 2_000_000


def _frequent(sets: DataFrame) -> np.ndarray:
    """The most frequent shingles of a part of the documents, rarest first."""
    part = max(1, sets.count() // COUNTED)
    counts = sets.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("f")).where("f > 1")
    found = counts.orderBy(F.desc("f"), "g").limit(FREQUENT).toArrow()
    return found.column("g").to_numpy()[np.lexsort((found.column("g").to_numpy(), found.column("f").to_numpy()))]


def _prefixes(frequent, width: Callable[[np.ndarray], np.ndarray]):
    """Each set's first ``width(n)`` shingles, in the order of their hashes, the frequent ones last by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(frequent.value)
        rank = np.argsort(frequent.value) + 1
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            n = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(n) - n
            late = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                late = np.where(known[at] == flat, rank[at], 0)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((late, row))  # stable: sets come sorted by hash
            kept = np.minimum(width(n), n)
            first = order[np.arange(len(flat)) - starts[row] < kept[row]]
            ends = np.concatenate([[0], np.cumsum(kept)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[first]))], ["id", "n", "first"])

    return run


def near_duplicates(df: DataFrame, key: str, text: Column, size: int = 3, threshold: float = 0.9, coverage: float = 0.8, mode: str = "both") -> DataFrame:
    """(a, b, common, n_a, n_b) with a < b: all pairs of different rows whose ``size``-token shingle sets are alike enough.

    ``text`` is an array of tokens. Mode ``both`` asks for common / union of ``threshold``; mode ``containment`` for common / the smaller set
    of ``threshold``. Both ask nothing of ``coverage`` beyond that unless it is above 0: the smaller set has at least
    that share of the larger one in mode ``both``. Exact: rows with equal sets are one class, linked by its smallest key;
    classes are joined by prefix filtering and confirmed on the full sets. Shingles stand in the order of their hashes, the most frequent of a part of the documents behind all
    others, so a set's first ones are found without a shuffle, and only they are sent on. Any order gives the same pairs. In mode ``both`` sets of lengths too far apart
    do not meet, and a pair must share several of its first shingles. Rows with fewer
    tokens than a shingle have one shingle of what there is; rows without tokens have none and match nothing.
    """
    both = mode == "both"
    hashed = df.select(F.col(key).alias("id"), F.transform(text, lambda w: F.xxhash64(w)).alias("h"))
    gram = lambda i: F.xxhash64(*[F.col("h")[i + k] for k in range(size)])
    grams = F.when(F.size("h") >= size, F.transform(F.sequence(F.lit(0), F.size("h") - size), gram)).when(F.size("h") > 0, F.array(F.xxhash64("h")))
    # written once, before any filter: the sets are read by every step below, and a predicate on them that was pushed
    # under the projection would compute the tokens anew for every shingle
    s = F.array_sort(F.array_distinct(grams))
    sets = written(hashed.select("id", s.alias("s")).select("id", "s", F.size("s").alias("n"), F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(1), "s").alias("d2")), "sets").where("n > 0")
    # equal sets meet by size and 128 bits of digest; only the smallest key's set goes on
    digest = ["n", "d1", "d2"]
    classes = written(sets.groupBy(*digest).agg(F.min("id").alias("rep")), "classes")
    members = written(sets.select("id", *digest).join(classes.hint("merge"), digest), "members")
    same = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("n").alias("common"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    # a pair has so many shingles in common at least, as a share of the smaller set and of the larger one
    of_small, of_large = (2 * threshold / (1 + threshold), threshold) if both else (threshold, 0.0)
    # if a pair has o in common, its first e + 1 are among the first n - o + 1 + e of either; e is below any such o unless the threshold is next to none
    several = both and of_small > 2 / SHARED
    width = lambda n: n - np.ceil(n * (of_large if both else of_small) - 1e-9).astype(np.int64) + 1 + (n // SHARED if several else 0)
    sent = df.sparkSession.sparkContext.broadcast(_frequent(sets))
    first = map_arrow(sets.select("id", "n", "s"), _prefixes(sent, width), f"id {dict(sets.dtypes)['id']}, n int, first array<bigint>")
    first = written(first.join(members.where("id = rep").select("id").distinct().hint("merge"), "id", "left_semi"), "firsts")
    # a set's length falls into its own range or the next one of the smaller set's
    wide = max(-math.log(max(threshold, 1e-9)), 1e-3) * (1 + 1e-6)
    span = F.floor(F.log(F.col("n").cast("double")) / wide).cast("int") if both else F.lit(0)
    extra = F.floor(F.col("n") / SHARED) if several else F.lit(0)
    narrow = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * of_small - 1e-9) + 1 + extra).cast("int")
    spans = F.explode(F.array(span, span + 1)) if both else F.lit(0)
    head = first.select("id", "n", F.explode(F.slice("first", F.lit(1), narrow)).alias("g")).select("id", "n", "g", spans.alias("span"))
    if both:
        other = first.select(F.col("id").alias("id2"), F.col("n").alias("n2"), span.alias("span"), F.explode("first").alias("g"))
    else:
        reps = sets.join(members.where("id = rep").select("id").distinct().hint("merge"), "id", "left_semi")
        other = reps.select(F.col("id").alias("id2"), F.col("n").alias("n2"), span.alias("span"), F.explode("s").alias("g"))
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    met = head.join(other.hint("merge"), ["g", "span"]).where(smaller)
    if both:
        met = met.where(F.col("n") >= F.col("n2") * threshold - 1e-9)
    counted = met.groupBy("id", "id2", "n").agg(F.count("*").alias("shared"))
    counted = counted.where(F.col("shared") > extra)
    pairs = written(counted.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")), "pairs")
    asked = beside(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), CANDIDATES)
    own = sets.select("id", "s").join(asked, "id", "left_semi")
    full = pairs.join(own.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(own.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    full = full.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), F.size("sa").alias("n_a"), F.size("sb").alias("n_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    ok = F.col("common") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("common")) if both else F.col("common") >= threshold * small
    if both:
        ok = ok & (small >= coverage * large)
    return same.unionByName(full.where(ok))
