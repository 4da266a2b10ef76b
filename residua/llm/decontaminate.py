"""Benchmark decontamination with spaced seeds and substitution-tolerant overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.scratch import written
from residua.ship import map_arrow

#: The masks; positions with 0 are ignored. Of n tokens with a fifth changed at most, the unchanged ones fall
#: into n // 5 + 1 runs; from 11 tokens on, one run has four tokens, or two runs of three stand beside one change.
MASKS = ("1111", "1110111")
#: Masks more for items of so many tokens, whose overlaps are the whole item and can escape the masks above.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11101", "11011", "10111"), 6: ("111011", "110111"), 10: ("1110110111",)}
#: A matching token counts 1 and another this much less than nothing, so a sum of 0 is four matches of five.
MISMATCH = 4
#: An overlap has so many tokens at least, or the whole item if that is shorter.
LEAST_TOKENS = 13
#: An overlap of twice ``LEAST_TOKENS`` or more has a half that is one as well, so each has a part of fewer tokens with a hit in it.
REACH = 2 * LEAST_TOKENS - 2
#: Hits that are looked at together, hits on one diagonal that are this near each other and speak for each other, and token pairs that are compared at once.
HITS, STRIDE, CELLS = 1 << 16, 16, 1 << 21
#: A benchmark of so many tokens, counted, is indexed on the driver and broadcast; seeds of a larger one are joined in a shuffle.
INDEX_TOKENS = 1_000_000
#: Bits of the filter that document seeds pass before that shuffle, at most.
FILTER_BITS = 27
#: Copies of a document's text, at most, over which the items that it may overlap with are spread when they are verified.
CHUNKS = 16

#: A token as ``tokens`` takes it, for counting.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(buf: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Runs of letters and digits, A-Z and Latin-1 capitals in lower case; all other ASCII parts them."""
    return W.words(W.lower_latin(buf), offsets, W.PUNCTUATION)


def seed_hashes(h: np.ndarray, offsets: list[int]) -> np.ndarray:
    """For each place the hash of the tokens at the given offsets from it."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(offsets), np.uint64)
    for o in offsets:
        out = out * np.uint64(0x9FB21C651E98DF25) + h[o : o + n]
    return W.mix(out)


def seeds_of(w: W.Words, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, token) of every place of a document where the mask fits."""
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    h = seed_hashes(w.hashes, offsets)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: len(h)]
    at = np.arange(len(h))
    keep = at + offsets[-1] < w.first[doc + 1]
    return h[keep], doc[keep], (at - w.first[doc])[keep]


def masks_for(lengths: set[int]) -> list[tuple[str, int | None]]:
    """The masks, each with the only length of items that it serves, if those are short."""
    return [(m, None) for m in MASKS] + [(m, n) for n, ms in SHORT_MASKS.items() if n in lengths for m in ms]


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The places of one of each of the distinct rows."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


def longest(same: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, matches, first) for each of several sequences laid end to end: the longest stretch with four matches of five; the most matches, then the
    first, on ties.

    A stretch from i to j will do if the sum of 1 for a match and -MISMATCH for another token is no lower at j than at i, so each j looks for the
    first sum that is no higher. The sums of each sequence lie below all of the one before, so that one search serves all.
    """
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    step = np.zeros(int((lengths + 1).sum()), np.int64)
    inner = np.ones(len(step), bool)
    inner[begin] = False
    step[inner] = np.where(same, 1, -MISMATCH)
    s = np.cumsum(step)
    below = (MISMATCH + 1) * int(lengths.max(initial=0)) + 2
    s -= np.repeat(s[begin] + np.arange(len(lengths)) * below, lengths + 1)
    i = np.searchsorted(-np.minimum.accumulate(s), -s, "left")
    n = np.arange(len(s)) - i
    size = np.maximum.reduceat(n, begin)
    gain = np.where(n == np.repeat(size, lengths + 1), s - s[i], -1)
    most = np.maximum.reduceat(gain, begin)
    first = np.minimum.reduceat(np.where(gain == np.repeat(most, lengths + 1), i, len(s)), begin) - begin
    return size, (most + MISMATCH * size) // (MISMATCH + 1), first


def verified(own: W.Words, doc: np.ndarray, its: W.Words, item: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first token, tokens, matches) of the longest overlap of each document and item, over all given diagonals; a
    diagonal is where the item's first token falls in the document."""
    n_own, n_its = np.diff(own.first)[doc], np.diff(its.first)[item]
    a = np.maximum(0, -diagonal)
    lengths = np.maximum(0, np.minimum(n_its, n_own - diagonal) - a)
    rows = []
    edge = np.unique([0, *np.searchsorted(np.cumsum(lengths), np.arange(CELLS, int(lengths.sum()), CELLS), "left"), len(doc)])
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        part = slice(lo, hi)
        n = lengths[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mine = np.repeat(own.first[doc[part]] + a[part] + diagonal[part], n) + step
        theirs = np.repeat(its.first[item[part]] + a[part], n) + step
        size, matched, first = longest(own.hashes[mine] == its.hashes[theirs], n)
        keep = size >= np.minimum(LEAST_TOKENS, n_its[part])
        rows.append(np.stack([doc[part], item[part], size, matched, -(first + a[part] + diagonal[part])], axis=1)[keep])
    if not rows:
        return []
    found = np.concatenate(rows)
    found = found[np.lexsort(found.T[::-1])]
    last = np.ones(len(found), bool)
    last[:-1] = np.any(found[1:, :2] != found[:-1, :2], axis=1)
    return [(d, i, -p, n, m) for d, i, n, m, p in found[last].tolist()]


class Index:
    """Seeds of all items of a benchmark that is small enough to be broadcast."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        buf, offsets = W.flat(pa.array(texts, pa.large_string()))
        w = tokens(buf, offsets)
        self.ids, self.words = np.array(ids, np.int64), w._replace(buf=np.zeros(0, np.uint8), starts=w.starts[:0], ends=w.ends[:0])
        lengths = np.diff(w.first)
        self.seeds = []
        for mask, only in masks_for(set(lengths.tolist())):
            h, items, places = seeds_of(w, mask)
            if only is not None:
                h, items, places = (x[lengths[items] == only] for x in (h, items, places))
            order = np.argsort(h, kind="stable")
            bits = max(16, int(len(h)).bit_length() + 3)
            seen = np.zeros(1 << bits, bool)
            seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.seeds.append((mask, h[order], items[order].astype(np.int32), places[order].astype(np.int32), bits, seen))

    def hits(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, diagonal) with an overlap around a seed that agrees."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, known, items, places, bits, seen in self.seeds:
            h, doc, at = seeds_of(w, mask)
            some = np.flatnonzero(seen[(h >> np.uint64(64 - bits)).astype(np.int64)])
            h, doc, at = h[some], doc[some], at[some]
            lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            doc, at, lo, n = doc[hi > lo], at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            for begin in range(0, int(n.sum()), HITS):
                pair = np.arange(begin, min(begin + HITS, int(ends[-1])))
                row = np.searchsorted(ends, pair, "right")
                k = lo[row] + pair - (ends - n)[row]
                rows = doc[row], items[k].astype(np.int64), at[row] - places[k], places[k].astype(np.int64)
                # of hits near each other on a diagonal, one speaks for all, so repeated tokens do not multiply
                one = _distinct(rows[0], rows[1], rows[2], rows[3] // STRIDE)
                d, i, diagonal, place = (x[one] for x in rows)
                ok = self.near(w, d, i, diagonal, place, len(mask))
                found.append(np.stack([d[ok], i[ok], diagonal[ok]], axis=1))
        rows = np.concatenate(found)
        rows = rows[_distinct(rows[:, 0], rows[:, 1], rows[:, 2])]
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def near(self, w: W.Words, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Whether the tokens around each hit, ``REACH`` and ``STRIDE`` to either side, hold an overlap; each overlap has a hit where they do."""
        step = np.arange(-REACH - STRIDE, width + REACH + STRIDE)
        its = self.words
        theirs = (its.first[item] + place)[:, None] + step
        mine = (w.first[doc] + diagonal + place)[:, None] + step
        there = (mine >= w.first[doc][:, None]) & (mine < w.first[doc + 1][:, None]) & (theirs >= its.first[item][:, None]) & (theirs < its.first[item + 1][:, None])
        same = w.hashes[np.clip(mine, 0, len(w.hashes) - 1)] == its.hashes[np.clip(theirs, 0, len(its.hashes) - 1)]
        s = np.zeros((len(doc), len(step) + 1), np.int32)
        np.cumsum(np.where(there, np.where(same, 1, -MISMATCH), -MISMATCH * len(step)), axis=1, out=s[:, 1:])
        low = np.minimum.accumulate(s, axis=1)
        need = np.minimum(LEAST_TOKENS, its.first[item + 1] - its.first[item])
        start = np.arange(s.shape[1]) - need[:, None]
        return ((s >= np.take_along_axis(low, np.maximum(start, 0), axis=1)) & (start >= 0)).any(axis=1)

    def overlaps(self, w: W.Words) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item id, first token, tokens, matches, item tokens) of the longest overlap of each document and item."""
        lengths = np.diff(self.words.first)
        doc, item, diagonal = self.hits(w)
        return [(d, int(self.ids[i]), p, n, m, int(lengths[i])) for d, i, p, n, m in verified(w, doc, self.words, item, diagonal)]


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(id, text, n): the distinct items that have tokens, and how many."""
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where("id is not null").distinct()
    return written(items.withColumn("n", F.regexp_count("text", F.lit(TOKEN)).cast("long")).where("n > 0"), "items")


def _index(items: DataFrame, index_tokens: int):
    """A broadcast index, or None if the counted tokens are too many for one."""
    if (items.agg(F.sum("n")).first()[0] or 0) > index_tokens:
        return None
    rows = items.select("id", "text").orderBy("id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))


def _find(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "item_id", "first_token", "n_tokens", "n_matched", "item_tokens"]
        for b in batches:
            for lo, _, buf, offsets in W.pieces(b.column(1)):
                rows = index.value.overlaps(tokens(buf, offsets))
                cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names]
                ids = b.column(0).take(pa.array([lo + d for d in cols[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

    return run


def _seed_rows(masks: list[tuple[str, int | None]], items: bool, seen=None, bits: int = 0):
    """(a, b, h, place) from rows (a, b, text): the seeds of documents that pass the filter, or of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, buf, offsets in W.pieces(b.column(2)):
                w = tokens(buf, offsets)
                lengths = np.diff(w.first)
                for number, (mask, only) in enumerate(masks):
                    h, doc, place = seeds_of(w, mask)
                    h = W.mix(h + np.uint64(number))
                    keep = np.ones(len(h), bool) if only is None or not items else lengths[doc] == only
                    if seen is not None:
                        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                        keep = (seen.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
                    row = pa.array(lo + doc[keep])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(W.as_long(h[keep])), pa.array(place[keep], pa.int32())], ["a", "b", "h", "place"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of each row's text with its items (id, text, n, diagonals)."""
    names = ["s1", "s2", "item_id", "first_token", "n_tokens", "n_matched", "item_tokens"]
    for b in batches:
        for k in range(b.num_rows):
            own = tokens(*W.flat(b.column(2).slice(k, 1)))
            asked = b.column(3)[k].as_py()
            its = tokens(*W.flat(pa.array([x["text"] for x in asked], pa.large_string())))
            item = np.repeat(np.arange(len(asked)), [len(x["diagonals"]) for x in asked])
            diagonal = np.concatenate([np.array(x["diagonals"], np.int64) for x in asked])
            rows = [(asked[i]["id"], p, n, m, asked[i]["n"]) for _, i, p, n, m in verified(own, np.zeros(len(item), np.int64), its, item, diagonal)]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names[2:]]
            keys = [b.column(j).take(pa.array([k] * len(rows), pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, pa.int64()) for c in cols]], names)


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(s1, s2, item_id, first_token, n_tokens, n_matched, item_tokens) for distinct texts (s1, s2, text), by a shuffle join of seed hashes.

    Document seeds first pass a bit filter of the items' seeds, whose size has a fixed bound. A joined pair of seeds is a diagonal; diagonals
    are gathered for each text and item, and both texts are laid over each other on them. Nothing but the filter is broadcast.
    """
    spark = items.sparkSession
    masks = masks_for({r[0] for r in items.where(F.col("n") <= max(SHORT_MASKS)).select("n").distinct().collect()})
    kind = "a long, b long, h long, place int"
    named = items.select(F.xxhash64("id", "text").alias("t"), "id", "text", "n")
    item_seeds = written(map_arrow(named.select(F.col("t").alias("a"), F.lit(0).cast("long").alias("b"), "text"), _seed_rows(masks, True), kind), "seeds")
    bits = min(FILTER_BITS, max(16, (8 * item_seeds.count()).bit_length()))
    slots = item_seeds.select(F.shiftrightunsigned("h", 64 - bits).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63L as int))")).alias("bits"))
    words = slots.toArrow()
    seen = np.zeros(1 << (bits - 6), np.int64)
    seen[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    seen = spark.sparkContext.broadcast(seen.view(np.uint64))
    doc_seeds = written(map_arrow(texts.select(F.col("s1").alias("a"), F.col("s2").alias("b"), "text"), _seed_rows(masks, False, seen, bits), kind), "seeds")
    met = doc_seeds.join(item_seeds.select("h", F.col("a").alias("t"), F.col("place").alias("its")).hint("merge"), "h")
    pairs = met.groupBy(F.col("a").alias("s1"), F.col("b").alias("s2"), "t").agg(F.collect_set(F.col("place") - F.col("its")).alias("diagonals"))
    asked = written(pairs, "diagonals").join(named.hint("merge"), "t").select("s1", "s2", F.pmod("t", F.lit(CHUNKS)).alias("chunk"), F.struct("id", "text", "n", "diagonals").alias("x"))
    asked = written(asked.groupBy("s1", "s2", "chunk").agg(F.collect_list("x").alias("asked")), "asked")
    both = texts.join(asked.hint("merge"), ["s1", "s2"]).select("s1", "s2", "text", "asked")
    return written(map_arrow(both, _verify, "s1 long, s2 long, item_id long, first_token long, n_tokens long, n_matched long, item_tokens long"), "overlaps")


def _text_key(text: str) -> list:
    return [F.xxhash64(text).alias("s1"), F.hash(text).cast("long").alias("s2")]


def _overlaps_of_texts(docs: DataFrame, text: str, items: DataFrame) -> DataFrame:
    own = docs.where(F.col(text).isNotNull()).select(*_text_key(text), F.col(text).alias("text"))
    return _joined(written(own.dropDuplicates(["s1", "s2"]), "texts"), items)


def overlaps(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """(key, item_id, first_token, n_tokens, n_matched, item_tokens): the longest overlap of each document with each item.

    Where all tokens under a mask agree, the item is laid over the document on that diagonal, and the longest stretch
    of which four of five tokens agree is an overlap if it has ``LEAST_TOKENS`` tokens or the whole item. The masks leave no
    such stretch without a hit, wherever its changes are. A benchmark of up to ``index_tokens`` tokens, counted, becomes a broadcast index: documents are
    read once and nothing is shuffled. The seeds of a larger one are joined with the documents' in a shuffle, for distinct texts, which a 96-bit hash tells
    apart. Repeated items count
    once. Null and empty texts overlap with nothing, null items are left
    out, repeated documents give repeated rows; keys are integers, a null key stays null; an empty benchmark or table gives no rows; other columns are
    not looked at. The work on a document and an item grows with the product of their lengths only where both repeat one token all along.
    """
    kind = "id long, item_id long, first_token long, n_tokens long, n_matched long, item_tokens long"
    items = _items(benchmark, item, item_text)
    index = _index(items, index_tokens)
    if index is not None:
        own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        return map_arrow(own, _find(index), kind).withColumnRenamed("id", key)
    found = _overlaps_of_texts(docs, text, items)
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), *_text_key(text))
    return own.join(found.hint("merge"), ["s1", "s2"]).drop("s1", "s2")


def _clean(index, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, _, buf, offsets in W.pieces(b.column(column)):
                keep[[lo + r[0] for r in index.value.overlaps(tokens(buf, offsets))]] = False
            yield b.filter(pa.array(keep))

    return run


def drop_overlapping(docs: DataFrame, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """``docs`` without the rows that overlap with any item, as ``overlaps`` finds them; all columns and all other rows as they are, without a shuffle up
    to ``index_tokens``; columns may have any name."""
    items = _items(benchmark, item, item_text)
    index = _index(items, index_tokens)
    if index is not None:
        return map_arrow(docs, _clean(index, docs.columns.index(text)), docs.schema)
    hit = written(_overlaps_of_texts(docs, text, items).select("s1", "s2").distinct(), "hit")
    tag = W.free_prefix(docs.columns)
    one, two = _text_key(text)
    keyed = docs.withColumns({f"{tag}s1": one, f"{tag}s2": two})
    return keyed.join(hit.hint("merge"), (keyed[f"{tag}s1"] == hit["s1"]) & (keyed[f"{tag}s2"] == hit["s2"]), "left_anti").select(*docs.columns)
