"""Ranked lexical search: accumulators of short lists, then document-at-a-time over long lists with skipping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm import words as W
from residua.scratch import written
from residua.ship import map_arrow

#: So many distinct terms of the queries are looked for in one pass over the corpus; more queries take more passes.
TERMS = 1 << 20
#: A list of postings is short if it has at most one in so many of a block's documents; so many candidates are scored between two looks at the threshold.
SHORT, RUN = 16, 512


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> W.Words:
    return W.words(W.lower_ascii(buf), offsets, W.PUNCTUATION)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offsets in W.pieces(b.column(1)):
            w = terms_of(buf, offsets)
            item = np.repeat(b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False), np.diff(w.first))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(W.as_long(w.hashes))], ["item", "term"])


def _postings(known: Broadcast):
    """(key, n, terms, tfs): of each document its length and those of its terms that some query has, by their place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for b in batches:
            for lo, hi, buf, offsets in W.pieces(b.column(1)):
                w = terms_of(buf, offsets)
                n = np.diff(w.first)
                at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
                hit = terms[at] == w.hashes
                doc = np.repeat(np.arange(hi - lo), n)[hit]
                both, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
                first = pa.array(np.searchsorted(both, np.arange(hi - lo + 1) * len(terms)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (both % len(terms), tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    return run


class Block:
    """The inverted lists of some documents, which stand by their keys: of each term, the documents and what they score."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray, docs: int, terms: int) -> None:
        order = np.argsort(term * docs + doc)
        self.doc, self.score, self.docs = doc[order], score[order], docs
        self.at = np.searchsorted(term[order], np.arange(terms + 1))
        self.most = np.zeros(terms, np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.score, self.at[some])

    def best(self, terms: np.ndarray, keep: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the ``keep`` best: none that score ``floor`` or more is left out, unless ``keep`` others score higher.

        Short lists are summed term-at-a-time; their sums are one list with the largest sum as its bound. Then documents
        are taken in order, a run at a time: those whose bound falls below the threshold are skipped, for the others
        the long lists are entered at the document, those of the highest bound first, until the rest cannot lift it any more.
        """
        size = self.at[terms + 1] - self.at[terms]
        terms = terms[size > 0]
        short = self.at[terms + 1] - self.at[terms] <= max(1, self.docs // SHORT)
        sums = np.zeros(self.docs, np.int64)
        for t in terms[short].tolist():
            a, b = self.at[t], self.at[t + 1]
            sums[self.doc[a:b]] += self.score[a:b]
        long_ = terms[~short]
        long_ = long_[np.argsort(-self.most[long_], kind="stable")]
        rest = np.append(np.cumsum(self.most[long_][::-1])[::-1], 0)  # of the lists from each on
        floor = max(1, floor)
        if rest[0] < floor:
            order = np.flatnonzero(sums + rest[0] >= floor)
        else:
            order = np.arange(self.docs)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = np.zeros(0, np.int64)
        for i in range(0, len(order), RUN):
            own = order[i : i + RUN]
            score = sums[own]
            for k, t in enumerate(long_.tolist()):
                stay = score + rest[k] >= floor
                own, score = own[stay], score[stay]
                if not len(own):
                    break
                a, b = self.at[t], self.at[t + 1]
                at = np.minimum(a + np.searchsorted(self.doc[a:b], own), b - 1)
                score = score + np.where(self.doc[at] == own, self.score[at], 0)
            stay = score >= floor
            own, score = own[stay], score[stay]
            docs.append(own)
            scores.append(score)
            held = np.sort(np.concatenate([held, score]))[-keep:]
            if len(held) == keep:
                floor = max(floor, int(held[0]))
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        stay = scores >= floor
        return docs[stay], scores[stay]


def top(keys: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """The places of the ``keep`` highest scores, ties by the smaller key."""
    return np.lexsort((keys, -scores))[:keep]


def _rank(index: Broadcast, keep: int):
    """The best of each task for each query, with the task's own threshold carried from block to block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n_docs, n_terms, items, first, terms = index.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            lists = b.column(2)
            at = np.asarray(lists.offsets).astype(np.int64)
            term = lists.values.to_numpy()[at[0] : at[-1]].astype(np.int64)
            tf = b.column(3).values.to_numpy()[at[0] : at[-1]].astype(np.int64)
            doc = np.repeat(np.arange(len(keys)), np.diff(at))
            m = 10 + (90 * b.column(1).to_numpy() * n_docs) // n_terms
            block = Block(doc, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(keys), len(weights))
            for i in range(len(items)):
                old_keys, old = best.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found, score = block.best(terms[first[i] : first[i + 1]], keep, int(old[-1]) if len(old) == keep else 0)
                if len(found):
                    both, scores = np.append(old_keys, keys[found]), np.append(old, score)
                    order = top(both, scores, keep)
                    best[i] = both[order], scores[order]
        for i, (keys, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), items[i]), pa.int64()), pa.array(keys), pa.array(scores)], ["item", "key", "score"])

    return run


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, keep: int = 10, terms_a_pass: int = TERMS) -> DataFrame:
    """(query_key, rank, key, score): of each query the ``keep`` documents that score highest, above 0, ties by the smaller key.

    One pass over the corpus keeps of each document its length and the counts of those terms that some query has; document
    frequencies come from all of it. A second one ranks blocks of documents by ``Block.best`` and leaves ``keep`` rows a query and task, of which
    the best are taken. The terms of the queries are broadcast; queries are dealt to as many passes as keep the terms of one
    at ``terms_a_pass`` or fewer (one query alone may have more), so the bound holds for any number of queries.

    Null texts have no terms. Documents with a null key count in all statistics but are never returned, repeated rows of a key are ranked one by one; rows of one query
    key are one query with the terms of all, those with a null key are dropped; keys are integers; other columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_key).cast("long").alias("item"), F.col(query_text).alias("text")).where("item is not null")
    asked = written(map_arrow(asked, _query_terms, "item long, term long").distinct(), "asked")
    # queries in ranges of their keys, each with a bounded number of terms
    sizes = asked.groupBy("item").agg(F.count("*").alias("terms"))
    bounds = [r["item"] for r in _ranges(sizes, terms_a_pass)]
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = None
    for lo, hi in pairwise([*bounds, None]):
        some = asked.where(F.col("item") >= lo) if hi is None else asked.where((F.col("item") >= lo) & (F.col("item") < hi))
        table = some.toArrow()  # a pass has a bounded number of terms
        terms, place = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
        postings = written(map_arrow(own, _postings(spark.sparkContext.broadcast(terms)), "key long, n long, terms array<int>, tfs array<int>"), "postings")
        n_docs, n_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(terms), np.int64)
        for t, n in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the pass at most
            df[t] = n
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        order = np.lexsort((place, table["item"].to_numpy()))
        items, first = np.unique(table["item"].to_numpy()[order], return_index=True)
        index = (weights, n_docs, n_terms, items, np.append(first, len(order)), place[order])
        best = map_arrow(postings.where("size(terms) > 0"), _rank(spark.sparkContext.broadcast(index), keep), "item long, key long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
        best = best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= keep)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, key long, score long, rank int")
    return found.select(F.col("item").alias(query_key), "rank", F.col("key").alias(key), "score")


def _ranges(sizes: DataFrame, most: int) -> list:
    """The first query of each pass. Running sums over ranges of keys: a window for each range, then the sums of the ranges before it."""
    parts = sizes.repartitionByRange("item").withColumn("part", F.spark_partition_id())
    parts = written(parts, "sizes")
    before, total = {}, 0
    for part, n in sorted(parts.groupBy("part").agg(F.sum("terms")).collect()):
        before[part], total = total, total + n
    if not before:
        return []
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    run = F.sum("terms").over(Window.partitionBy("part").orderBy("item")) + base[F.col("part")]
    dealt = parts.withColumn("pass", F.floor((run - 1) / most))
    return dealt.groupBy("pass").agg(F.min("item").alias("item")).orderBy("pass").collect()
