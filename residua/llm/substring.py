"""Substring dedup by relative Lempel-Ziv parsing against content-defined reference blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.scratch import written
from residua.ship import map_arrow

#: Bits of a packed word position; the bits above them compare hashes. A piece of texts has less than 2**31 bytes, so its words fit.
_AT = np.uint64((1 << 32) - 1)
_BLOCK = "anchor long, span long, id long, sig long, first int, windows int, leads boolean"
_WINDOW = "anchor long, hash long, id long, sig long, first int, leads boolean"


def leads(doc: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its document with its hashes."""
    key = W.mix(doc.astype(np.uint64))
    for h in hashes:
        key = W.mix(key ^ h)
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == size else np.minimum(x[: len(x) - (size - have)], x[size - have :])


def blocks(w: W.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Reference blocks (document, first word in it, number of windows, anchor, whole-block hash).

    The anchor of a window is its least ``gram``-word hash, the leftmost on ties, so equal windows have equal anchors
    at equal places. A block is the run of consecutive windows that share an anchor; its text reaches from the first
    word of the first window to the last word of the last.
    """
    none = np.zeros(0, np.int64)
    n = len(w.hashes)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolled = W.word_runs(w)
    at = np.arange(n - gram + 1)
    grams = rolled.runs(at, at + gram)
    least = sliding_min((grams & ~_AT) | (at.astype(np.uint64) & _AT), window - gram + 1)
    begin = np.arange(len(least))
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: len(least)]
    begin = begin[begin + window <= w.first[doc + 1]]
    if not len(begin):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    doc = doc[begin]
    anchor = begin + ((least[begin] - begin.astype(np.uint64)) & _AT).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    count = np.diff(np.append(i, len(begin)))
    first = begin[i]
    return doc[i], first - w.first[doc[i]], count, grams[anchor[i]], rolled.runs(first, first + count - 1 + window)


def _block_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, offsets in W.pieces(b.column(2)):
                doc, first, count, anchor, span = blocks(W.words(buf, offsets), window, gram)
                keep = known[lo + doc]
                rows = [pa.array(x[keep], pa.int64()) for x in (W.as_long(anchor), W.as_long(span), ids[lo + doc], sigs[lo + doc])]
                rows += [pa.array(first[keep], pa.int32()), pa.array(count[keep], pa.int32()), pa.array(leads(doc, span, anchor)[keep])]
                yield pa.RecordBatch.from_arrays(rows, ["anchor", "span", "id", "sig", "first", "windows", "leads"])

    return run


def _window_rows(window: int):
    """The single windows of the asked blocks (anchor, first word, windows): (anchor, window hash, id, sig, first word, leads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            asked = b.column(3)
            at_of, ask = np.asarray(asked.offsets) - asked.offsets[0].as_py(), asked.flatten()
            anchors, places, counts = (ask.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for lo, hi, buf, offsets in W.pieces(b.column(2)):
                w = W.words(buf, offsets)
                i = np.arange(at_of[lo], at_of[hi])
                if not len(i):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(at_of[lo : hi + 1]))
                count = counts[i].astype(np.int64)
                k = np.repeat(np.arange(len(i)), count)
                step = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                first = places[i][k] + step
                begin = w.first[doc[k]] + first
                hashes = W.word_runs(w).runs(begin, begin + window)
                rows = [pa.array(x, pa.int64()) for x in (anchors[i][k], W.as_long(hashes), ids[lo + doc[k]], sigs[lo + doc[k]])]
                rows += [pa.array(first, pa.int32()), pa.array(leads(doc[k], hashes, anchors[i][k].view(np.uint64)))]
                yield pa.RecordBatch.from_arrays(rows, ["anchor", "hash", "id", "sig", "first", "leads"])

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("sig"), F.col(text).alias("text"))


def repeated_windows(docs: DataFrame, key: str, text: str, window: int = 50, gram: int = 12) -> DataFrame:
    """(id, sig, first, windows, ref, ref_first): runs of windows of ``window`` words that also start in a document with a smaller key,
    each with its reference: for a block that is matched as a whole, the smallest key that has all of it, else for each window the smallest key that has it; and the word where the
    run begins there (the first such place).

    Every document is cut into content-defined blocks, and all blocks of all documents are indexed by anchor and by text. A block that a
    smaller key has as a whole is matched with all its windows at once;
    where only the anchor is shared, the block stands at a factor's boundary, and its windows are checked one by one,
    once for each distinct block text. Rows repeated in key and text repeat their runs. So the result is exact and its work linear in the words, however many
    documents share a passage. Texts are words of ``[^\\x20\\x09-\\x0D]+``, unchanged. Null keys are nobody's
    reference and lose nothing; null and short texts have no windows.
    """
    keyed = _keyed(docs, key, text)
    found = map_arrow(keyed, _block_rows(window, gram), _BLOCK)
    place = F.min_by("first", F.when(F.col("leads"), F.col("id")))
    seen = found.groupBy("anchor").agg(F.min("id").alias("ref"), F.max("id").alias("most"), F.min("span").alias("a"), F.max("span").alias("b"), place.alias("ref_first"))
    shared = seen.where("ref < most").select("anchor", "ref", "ref_first", (F.col("a") != F.col("b")).alias("mixed"))
    # written, so that the join's sides are plain shuffles and a passage that very many documents share can be split
    shared = written(shared, "anchors")
    shared = written(found.join(shared.hint("merge"), "anchor"), "blocks")
    mixed = shared.where("mixed").drop("ref", "ref_first", "mixed")
    whole = written(mixed.groupBy("anchor", "span").agg(F.min("id").alias("ref"), place.alias("ref_first")), "spans")
    placed = mixed.join(whole.hint("merge"), ["anchor", "span"])
    out = ["id", "sig", "first", "windows", "ref", "ref_first"]
    sure = shared.where("not mixed and id > ref").select(*out).unionByName(placed.where("id > ref").select(*out))
    asked = placed.where("id = ref").groupBy("id", "sig").agg(F.array_sort(F.collect_set(F.struct("anchor", "first", "windows"))).alias("asked"))
    single = keyed.join(asked.hint("merge"), ["id", "sig"]).select("id", "sig", "text", "asked")
    single = map_arrow(single, _window_rows(window), _WINDOW)
    firsts = written(single.groupBy("anchor", "hash").agg(F.min("id").alias("ref"), F.max("id").alias("most"), place.alias("ref_first")).where("ref < most").drop("most"), "windows")
    late = single.join(firsts.hint("merge"), ["anchor", "hash"]).where("id > ref").withColumn("windows", F.lit(1))
    return sure.unionByName(late.select(*out))


def factors(first: np.ndarray, windows: np.ndarray, ref: np.ndarray, ref_first: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The parse of one document from its matched runs: factors (first word, words, reference, first word there), from left to right.

    A factor takes, greedily, every window that follows at the next place of the same reference; where the reference or the place changes
    or a window has none, it ends, and the next one begins at the next matched window. So a factor is never shorter than a window, and two that
    overlap share fewer words than a window.
    """
    out: list[list[int]] = []
    order = np.argsort(first, kind="stable")
    for a, n, r, at in zip(*(x[order].tolist() for x in (first, windows, ref, ref_first)), strict=True):
        if out and a + window - 1 == out[-1][0] + out[-1][1] and r == out[-1][2] and at - a == out[-1][3] - out[-1][0]:
            out[-1][1] += n
        else:
            out.append([a, n - 1 + window, r, at])
    return [tuple(x) for x in out]


_FACTORS = "array<struct<first:int,words:int,ref:bigint,ref_first:int>>"


def _cut(window: int):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("ref", pa.int64()), ("ref_first", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3).fill_null([])
            at, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten()
            cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for lo, hi, buf, offsets in W.pieces(b.column(2)):
                total, gone, kept, spans = [], [], [], []
                for i in range(lo, hi):
                    own = buf[offsets[i - lo] : offsets[i - lo + 1]].tobytes().split()
                    cut = factors(*(c[at[i] : at[i + 1]] for c in cols), window)
                    n = len(own)
                    if cut:
                        stay = np.ones(n, bool)
                        for a, k, _, _ in cut:
                            stay[a : a + k] = False
                        own = list(compress(own, stay.tolist()))
                    total.append(n)
                    gone.append(n - len(own))
                    kept.append(b" ".join(own).decode())
                    spans.append([{"first": a, "words": k, "ref": r, "ref_first": p} for a, k, r, p in cut])
                columns = [b.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_text", "factors"])

    return run


def drop_repeats(docs: DataFrame, key: str, text: str, window: int = 50, gram: int = 12) -> DataFrame:
    """(key, n_words, n_removed, kept_text, factors) for each row: the words that no factor covers, joined by one space.

    A factor (first, words, ref, ref_first) is a stretch of ``words`` >= ``window`` words that document ``ref`` has from word ``ref_first`` on; see
    ``factors``. Its spans are duplicates; windows that straddle two factors or stick out of one have been checked on their own, so a word
    goes if and only if a repeated window covers it. Windows are judged on the input, not on what is left. Repeated rows of one key are
    judged by their own text, and rows equal in both have the same factors, gathered once; null texts are empty; keys are integers; other columns are not looked at; an empty table gives none.
    """
    runs = repeated_windows(docs, key, text, window, gram)
    per = runs.groupBy("id", "sig").agg(F.collect_set(F.struct("first", "windows", "ref", "ref_first")).alias("runs"))
    full = _keyed(docs, key, text).join(per.hint("merge"), ["id", "sig"], "left").select("id", "sig", "text", "runs")
    kind = f"id long, n_words long, n_removed long, kept_text string, factors {_FACTORS}"
    return map_arrow(full, _cut(window), kind).withColumnRenamed("id", key)
