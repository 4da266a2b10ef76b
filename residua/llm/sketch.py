"""Document fingerprints: threshold-scaled sketches of all byte shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.scratch import written
from residua.ship import map_arrow, shipped

#: A shingle is this many bytes of UTF-8; its hash has BITS bits. Sketches keep the hashes below 2**BITS / SCALE, and those of texts with fewer than
#: LEAST of them keep all.
SHINGLE, SCALE, BITS, LEAST = 8, 16, 40, 8
#: Bytes of text in a range of keys, about, ranges at most, and ranges that a task holds on average: small ranges, since a hash deals them to tasks.
RANGE_BYTES, MOST_RANGES, TASK_RANGES = 2 << 20, 100_000, 8


class Sketch(NamedTuple):
    """All distinct shingle hashes below 2**BITS / scale, sorted. The scale goes with the hashes, so that sketches of different scales still compare and
    merge, at the coarser one."""

    scale: int
    hashes: np.ndarray

    def at(self, scale: int) -> np.ndarray:
        return self.hashes if scale == self.scale else self.hashes[self.hashes < np.uint64((1 << BITS) // scale)]


def sketches(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[Sketch]:
    """For each text its sketch: at ``scale``, or at 1 if fewer than LEAST hashes are below that threshold. A text shorter than a shingle is one shingle,
    an empty or null one has none."""
    out: list[Sketch] = []
    limit, drop = np.uint64((1 << BITS) // scale), np.uint64(64 - BITS)
    for lo, hi, buf, offsets in W.pieces(texts):
        runs = W.byte_runs(buf)
        at = np.arange(max(0, len(buf) - shingle + 1))
        h = runs.runs(at, at + shingle) >> drop
        near = np.flatnonzero(h < limit)
        doc = np.searchsorted(offsets, near, "right") - 1
        inside = near + shingle <= offsets[doc + 1]
        near, doc = near[inside], doc[inside]
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            a, b = int(offsets[d]), int(offsets[d + 1])
            kept = np.unique(h[near[cut[d] : cut[d + 1]]])
            if len(kept) >= LEAST:
                out.append(Sketch(scale, kept))
            elif b - a >= shingle:
                out.append(Sketch(1, np.unique(h[a : b - shingle + 1])))
            else:
                out.append(Sketch(1, runs.runs(np.array([a]), np.array([b])) >> drop if b > a else np.zeros(0, np.uint64)))
    return out


def encode(sketch: Sketch) -> str:
    """Hex digits: two of the scale's logarithm, then 10 for each hash, ascending."""
    return f"{sketch.scale.bit_length() - 1:02x}" + sketch.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def decode(text: str) -> Sketch:
    raw = np.frombuffer(bytes.fromhex(text[2:]), np.uint8).reshape(-1, BITS // 8)
    return Sketch(1 << int(text[:2], 16), np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).reshape(-1).view(">u8").astype(np.uint64))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the shingles of two documents taken together, at the coarser of their scales."""
    scale = max(a.scale, b.scale)
    return Sketch(scale, np.union1d(a.at(scale), b.at(scale)))


def _shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    scale = max(a.scale, b.scale)
    x, y = a.at(scale), b.at(scale)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """The share of the union that both have, at the coarser scale; the sketches of two empty texts are alike."""
    both, x, y = _shared(a, b)
    return both / (x + y - both) if x + y else float(len(a.hashes) == len(b.hashes))


def containment(a: Sketch, b: Sketch) -> float:
    """The share of the first that the second has, for documents of very unequal lengths; an empty text is contained in every one. If the first is so
    short that it has nothing at the second's scale, 0 stands for unknown."""
    both, x, _ = _shared(a, b)
    return both / x if x else float(not len(a.hashes))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, fingerprint) of every row; map-only. Null text is empty, keys are integers or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(W.flat(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([encode(s) for s in sketches(b.column(1))], pa.string())], [key, "n_bytes", "fingerprint"])

    own = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return map_arrow(own, run, f"`{key}` long, n_bytes long, fingerprint string")


def _bounds(keys: DataFrame, ranges: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The (k, h) at which ranges of about as many rows begin, from about 16 sampled keys a range, equal ones counted together."""
    if ranges < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    picked = keys.where(F.pmod(F.xxhash64("k", "h"), F.lit(max(1, rows // (16 * ranges)))) == 0).groupBy("k", "h").count().collect()
    picked.sort()
    ends = np.cumsum([r[2] for r in picked])
    at = np.unique(np.searchsorted(ends, np.arange(1, ranges) * (ends[-1] / ranges))) if len(picked) else []
    chosen = [picked[i] for i in at if i]
    return np.array([r[0] for r in chosen], np.int64), np.array([r[1] for r in chosen], np.int64)


def with_next(docs: DataFrame, key: str, text: str, ranges: int | None = None) -> DataFrame:
    """(part, ahead, id, text): the rows dealt to contiguous ranges of (key, hash of the text), each range followed by a copy of the next
    one's first row (``ahead`` 1; after the last range comes the first). Nulls are the smallest key.

    The number of ranges follows the bytes of the texts. Bounds come from a sample of the keys, so only some numbers a range and the ranges' first keys come
    to the driver, and a key that very many rows have is split by its texts' hash; texts are shuffled once.
    """
    spark = docs.sparkSession
    shipped(spark)
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    keys = written(own.select("k", "h", F.octet_length("text").alias("bytes")), "keys")
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cut_k, cut_h = _bounds(keys, ranges or min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))), rows)

    @F.pandas_udf("int")
    def part(k: pd.Series, h: pd.Series) -> pd.Series:
        bound = np.arange(len(cut_k) + len(k)) < len(cut_k)
        order = np.lexsort((~bound, np.concatenate([cut_h, h.to_numpy()]), np.concatenate([cut_k, k.to_numpy()])))
        passed = np.empty(len(order), np.int64)
        passed[order] = np.cumsum(bound[order])
        return pd.Series(passed[len(cut_k) :].astype("int32"))

    first = keys.withColumn("part", part("k", "h")).groupBy("part").agg(F.min(F.struct("k", "h")).alias("z")).collect()
    firsts = sorted((r["part"], r["z"]["k"], r["z"]["h"]) for r in first)
    before = spark.createDataFrame([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], "k long, h long, part int")
    follow = own.join(F.broadcast(before), ["k", "h"]).groupBy("k", "h", "part").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    dealt = own.withColumn("part", part("k", "h")).select("part", F.lit(0).alias("ahead"), "k", "h", "id", "text")
    both = dealt.unionByName(follow.select("part", F.lit(1).alias("ahead"), "k", "h", "id", "text"))
    return both.repartition(-(-len(firsts) // TASK_RANGES) or 1, "part").sortWithinPartitions("part", "ahead", "k", "h", "text").select("part", "ahead", "id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it: the edited text and both fingerprints."""
    held: list[tuple[int, int, int | None, str]] = []

    def done(rows: list[tuple], after: tuple | None) -> pa.RecordBatch:
        follow = [*rows[1:], after]
        own = [(r, f) for r, f in zip(rows, follow, strict=True) if r[1] == 0]
        edited = [r[3][: len(r[3]) - len(r[3]) // 4] + f[3][: len(r[3]) // 4] for r, f in own]
        prints = sketches(pa.array([r[3] for r in rows] + ([after[3]] if after else []), pa.large_string()))
        of = {id(r): s for r, s in zip([*rows, *([after] if after else [])], prints, strict=True)}
        changed = sketches(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for r, _ in own], pa.int64()),
                pa.array([len(r[3]) for r, _ in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([encode(of[id(r)]) for r, _ in own], pa.string()),
                pa.array([encode(s) for s in changed], pa.string()),
                pa.array([likeness(of[id(r)], s) for (r, _), s in zip(own, changed, strict=True)], pa.float64()),
                pa.array([likeness(of[id(r)], of[id(f)]) for r, f in own], pa.float64()),
                pa.array([containment(of[id(r)], of[id(f)]) for r, f in own], pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_next"],
        )

    for b in batches:
        for lo, hi, _, _ in W.pieces(b.column(3)):
            held += zip(*(b.column(i).slice(lo, hi - lo).to_pylist() for i in range(4)), strict=True)
            if len(held) > 1:
                yield done(held[:-1], held[-1])
                held = held[-1:]
    if held:
        yield done(held, None)


def edited_fingerprints(docs: DataFrame, key: str, text: str, ranges: int | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_next) of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row
    in order of (key, hash of the text, text); after the last comes the first. ``near_*`` are likenesses of fingerprints; ``in_next`` is
    the share of a document's fingerprint that the next one contains. Null text is empty, a null key comes first, a
    lone row is its own successor, an empty table gives an empty result; keys are integers; other columns are not looked at. Rows with one key and one
    text are not split over tasks.
    """
    kind = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_next double"
    return map_arrow(with_next(docs, key, text, ranges), _pairs, kind).withColumnRenamed("id", key)
