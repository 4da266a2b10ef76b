"""Alignment of two tokenizers: token streams of one text cut where both end, long texts as fragments of an associative monoid."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.llm.tokencount import PATTERN
from residua.scratch import written
from residua.ship import map_arrow, shipped

DEFAULT_A, DEFAULT_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more bytes are cut into byte ranges of about so many, which different tasks encode; so many neighbours are composed at once.
CHUNK_BYTES, FAN = 1 << 16, 8
#: So many bytes of short texts are encoded together, and so many links judged together.
TOGETHER, LINKS = 1 << 19, 1 << 18
#: At most so many id pairs, the most frequent ones, are broadcast; links of the others meet their counts in a join.
FREQUENT = 1 << 20
#: The first tokenizer's pre-tokens always end between something visible and a blank or a new line.
A_CUT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])")
_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters are themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their tokens; ids of the second follow those of the first in tables that hold both."""

    def __init__(self, first: bytes, second: bytes) -> None:
        import sentencepiece
        import tiktoken

        table = byte_alphabet()
        vocab = json.loads(first)["model"]["vocab"]
        special = {x["content"] for x in json.loads(first)["added_tokens"]}
        bytes_a = {i: bytes(table[c] for c in token) for token, i in vocab.items() if token not in special}
        self.a = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks={b: i for i, b in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        control = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(self.n_b)]
        bytes_b = [b"" if control[i] else bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        tokens = [*[bytes_a.get(i, b"") for i in range(self.n_a)], *bytes_b]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # adjacent characters of any piece: between others the second tokenizer never joins
        whole = [p.replace(_MARK, " ") for i, p in enumerate(pieces) if not control[i] and not self.b.is_byte(i)]
        self.joins = {p[i : i + 2] for p in whole for i in range(len(p) - 1)}
        if any("\n" in x for x in self.joins):
            raise ValueError("the second tokenizer joins new lines with other characters")
        self.guard = self.b.encode("\n")
        ids = [str(i) for i in range(self.n_a)] + [str(i) for i in range(self.n_b)]
        self.said = [x + mark for mark in ",|;" for x in ids]

    def encode_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode_b(self, text: str, begins: bool) -> list[int]:
        """The tokens of a text that begins a document, after its space, or goes on where nothing is joined."""
        return self.b.encode(text, num_threads=1) if begins else self.b.encode("\n" + text, num_threads=1)[len(self.guard) :]

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of tokens of the table of both."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


_PAIRS: dict[bytes, Pair] = {}


def pair_of(files: Broadcast) -> Pair:
    """Both tokenizers, built once in each process."""
    first, second = files.value
    key = hashlib.sha256(first).digest() + hashlib.sha256(second).digest()
    if key not in _PAIRS:
        _PAIRS[key] = Pair(first, second)
    return _PAIRS[key]


def tokenizer_files(spark: SparkSession, first: str = DEFAULT_A, second: str = DEFAULT_B) -> Broadcast:
    with open(first, "rb") as a, open(second, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def vocabulary_size(second: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=second).vocab_size()


class Tokens(NamedTuple):
    """Tokens of both kinds with the byte offsets where they end; offsets count from the document's start."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def after(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(other, self, strict=True)))

    def between(self, lo: int, hi: int) -> Tokens:
        """Those that end after ``lo`` and not after ``hi``."""
        i, j, k, m = (int(np.searchsorted(ends, at, "right")) for ends in (self.a_ends, self.b_ends) for at in (lo, hi))
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


NO_TOKENS = Tokens(*(np.zeros(0, np.int64),) * 4)


def common_ends(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the first kind, whether one of the second ends with it, and those tokens' places."""
    if not len(t.b_ends):
        return np.zeros(len(t.a_ends), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(t.b_ends, t.a_ends), len(t.b_ends) - 1)
    both = t.b_ends[at] == t.a_ends
    return both, at[both]


def said_groups(pair: Pair, t: Tokens, both: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The groups of tokens that all end at or before the last common end, as strings in order, and where each group ends among them."""
    n, m = len(t.a), len(t.b)
    ends_b = np.zeros(m, bool)
    ends_b[at] = True
    ga, gb = np.cumsum(both) - both, np.cumsum(ends_b) - ends_b
    until_a, until_b = np.flatnonzero(both) + 1, at + 1
    codes = np.empty(n + m, np.int64)
    size = pair.n_a + pair.n_b
    codes[np.arange(n) + np.append(0, until_b)[ga]] = t.a + size * both
    codes[np.arange(m) + until_a[gb]] = t.b + pair.n_a + 2 * size * ends_b
    return [pair.said[c] for c in codes.tolist()], until_a + until_b


def said_one(pair: Pair, t: Tokens) -> str:
    return ",".join(map(str, t.a.tolist())) + "|" + ",".join(map(str, t.b.tolist())) + ";"


class Fragment(NamedTuple):
    """A stretch of a document: tokens up to its first common end (all, if it has none), closed groups, tokens after its last common end.

    ``compose`` is associative: what one fragment leaves open at its end and the next one at its start is cut again where both kinds end, so any
    grouping of neighbours gives the same document.
    """

    head: Tokens
    cut: bool
    closed: str
    groups: int
    links: np.ndarray
    tail: Tokens


def fragment(pair: Pair, t: Tokens) -> Fragment:
    both, at = common_ends(t)
    none = np.zeros(0, np.int64)
    if not both.any():
        return Fragment(t, False, "", 0, none, NO_TOKENS)
    ends = t.a_ends[both]
    head, mid, tail = t.between(-1, ends[0]), t.between(ends[0], ends[-1]), t.between(ends[-1], np.iinfo(np.int64).max)
    closed = "".join(said_groups(pair, mid, *common_ends(mid))[0]) if len(ends) > 1 else ""
    return Fragment(head, True, closed, len(ends) - 1, t.a[both] * pair.n_b + t.b[at], tail)


def compose(pair: Pair, x: Fragment, y: Fragment) -> Fragment:
    """Two neighbours as one; links are those of both and those at common ends that only the two together show."""
    open_ = fragment(pair, y.head.after(x.tail if x.cut else x.head))
    # the end of y's head is a common end that y has told already
    links = [x.links, y.links, open_.links[:-1] if y.cut else open_.links]
    if not open_.cut:
        mid, n, head = "", 0, x.head if x.cut else open_.head
    elif x.cut:
        mid, n, head = said_one(pair, open_.head) + open_.closed, open_.groups + 1, x.head
    else:
        mid, n, head = open_.closed, open_.groups, open_.head
    tail = y.tail if y.cut else open_.tail if open_.cut else open_.head if x.cut else NO_TOKENS
    return Fragment(head, x.cut or open_.cut, x.closed + mid + y.closed, x.groups + n + y.groups, np.concatenate(links), tail)


def digest(said: str) -> str:
    return hashlib.sha256(said[:-1].encode()).hexdigest() if said else ""


def cuts(pair: Pair, text: str, size: int) -> tuple[list[int], list[int]]:
    """For both tokenizers, the first places at or after each multiple of ``size`` characters where nothing joins; the text's end, where none follows."""
    n = len(text)
    a, b = [], []
    for at in range(size, n, size):
        i = max(at, a[-1] if a else 0)
        found = A_CUT.search(text, i) if i < n else None
        a.append(found.start() if found else n)
        i = max(at, b[-1] if b else 0)
        while i < n and text[i - 1 : i + 1] in pair.joins:
            i += 1
        b.append(i)
    return a, b


_SHORT = "row long, key long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"


def _whole(files: Broadcast):
    """Short texts, many at once: streams of all that keep their bytes are laid end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for batch in batches:
            for lo, hi, _, _ in W.pieces(batch.column(2), TOGETHER):
                texts = [x or "" for x in batch.column(2).slice(lo, hi - lo).to_pylist()]
                a = [pair.encode_a(" " + x) if x else np.zeros(0, np.int64) for x in texts]
                b = pair.b.encode(texts, num_threads=1)
                counts = [np.array([len(x) for x in y], np.int64) for y in (a, b)]
                ids_a = np.concatenate(a)
                ids_b = np.fromiter(chain.from_iterable(b), np.int64, int(counts[1].sum()))
                keep = np.array([bool(x) for x in texts])
                for ids, n in ((ids_a, counts[0]), (ids_b + pair.n_a, counts[1])):
                    made, size = pair.joined(ids), np.append(0, np.cumsum(pair.lengths[ids]))
                    at = np.append(0, np.cumsum(n))
                    for i in np.flatnonzero(keep).tolist():
                        keep[i] = made[size[at[i]] : size[at[i + 1]]] == b" " + texts[i].encode()
                ids_a, ids_b = ids_a[np.repeat(keep, counts[0])], ids_b[np.repeat(keep, counts[1])]
                counts = [np.where(keep, n, 0) for n in counts]
                t = Tokens(ids_a, np.cumsum(pair.lengths[ids_a]), ids_b, np.cumsum(pair.lengths[ids_b + pair.n_a]))
                both, at = common_ends(t)
                said, until = said_groups(pair, t, both, at)
                links = t.a[both] * pair.n_b + t.b[at]
                until_a = np.append(0, np.cumsum(counts[0]))
                groups = np.diff(np.append(0, np.cumsum(both))[until_a])
                first = np.append(0, np.cumsum(groups))
                place = np.append(0, until)[first].tolist()
                told = [digest("".join(said[i:j])) for i, j in zip(place[:-1], place[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                columns = [part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (*counts, groups)], pa.array(told, pa.string())]
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(links, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


_CHUNK = "row long, key long, part long, parts long, a_at long, b_at long, a_text string, b_text string"


def _chunks(files: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        kind = [pa.int64()] * 6 + [pa.string()] * 2
        names = [x.split()[0] for x in _CHUNK.split(", ")]
        for batch in batches:
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = cuts(pair, text, size)
                n, at, bt = len(a) + 1, [0, *a, len(text)], [0, *b, len(text)]
                # both streams begin with the space before the text
                a_at = b_at = 0
                for i in range(n):
                    x, y = text[at[i] : at[i + 1]], text[bt[i] : bt[i + 1]]
                    x = x if i else " " + x
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row, key, i, n, a_at, b_at, x, y), kind, strict=True)], names)
                    a_at, b_at = a_at + len(x.encode()), b_at + len(y.encode()) + (i == 0)

    return run


_TOKENS = "struct<a:array<bigint>,a_ends:array<bigint>,b:array<bigint>,b_ends:array<bigint>>"
_FRAGMENT = f"row long, key long, part long, parts long, ok boolean, n_a long, n_b long, head {_TOKENS}, cut boolean, closed string, n_groups long, links array<bigint>, tail {_TOKENS}"
_LIST = pa.list_(pa.int64())
_TOKEN_KIND = pa.struct([(n, _LIST) for n in Tokens._fields])
_FRAGMENT_KIND = pa.schema(
    [("row", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64())]
    + [("head", _TOKEN_KIND), ("cut", pa.bool_()), ("closed", pa.string()), ("n_groups", pa.int64()), ("links", _LIST), ("tail", _TOKEN_KIND)]
)


def _row(first: dict, part: int, parts: int, ok: bool, n_a: int, n_b: int, f: Fragment, links: np.ndarray) -> dict:
    plain = [{k: v.tolist() for k, v in t._asdict().items()} for t in (f.head, f.tail)]
    return {"row": first["row"], "key": first["key"], "part": part, "parts": parts, "ok": ok, "n_a": n_a, "n_b": n_b, "head": plain[0], "cut": f.cut, "closed": f.closed, "n_groups": f.groups, "links": links.tolist(), "tail": plain[1]}


def _fragment_of(r: dict) -> Fragment:
    head, tail = (Tokens(*(np.array(r[k][n], np.int64) for n in Tokens._fields)) for k in ("head", "tail"))
    return Fragment(head, r["cut"], r["closed"], r["n_groups"], np.zeros(0, np.int64), tail)


def _encode(files: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a = pair.encode_a(r["a_text"])
                b = np.array(pair.encode_b(r["b_text"], r["part"] == 0), np.int64)
                ok = pair.joined(a) == r["a_text"].encode() and pair.joined(b + pair.n_a) == (b"" if r["part"] else b" ") + r["b_text"].encode()
                t = Tokens(a, r["a_at"] + np.cumsum(pair.lengths[a]), b, r["b_at"] + np.cumsum(pair.lengths[b + pair.n_a]))
                f = fragment(pair, t if ok else NO_TOKENS)
                yield pa.RecordBatch.from_pylist([_row(r, r["part"], r["parts"], ok, len(a), len(b), f, f.links)], _FRAGMENT_KIND)

    return run


def _compose(files: Broadcast):
    """The fragments of one place of the next level as one; its links are only those that the composition has added."""

    def run(some: pa.Table) -> pa.Table:
        pair = pair_of(files)
        rows = sorted(some.to_pylist(), key=lambda r: r["part"])
        whole = _fragment_of(rows[0])
        for r in rows[1:]:
            whole = compose(pair, whole, _fragment_of(r))
        first = rows[0]
        made = _row(first, first["part"] // FAN, -(-first["parts"] // FAN), True, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), whole, whole.links)
        return pa.Table.from_pylist([made], _FRAGMENT_KIND)

    return run


def _finish(files: Broadcast):
    """A whole document's fragment: its head is its first group, and nothing is open at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                f = _fragment_of(r)
                made = [r["row"], r["key"], r["n_a"], r["n_b"], f.groups + 1, digest(said_one(pair, f.head) + f.closed)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], ["row", "key", "n_a", "n_b", "n_groups", "groups_sha256"])

    return run


def _judge(frequent: Broadcast, n_b: int):
    """Per row: links, those whose count is their second id's highest, the sum of counts, and the pairs that are not among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = frequent.value
        for batch in batches:
            lists = batch.column(1)
            offsets, values = np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + LINKS, "right")) - 1))
                at, links = offsets[lo : hi + 1] - offsets[lo], values[offsets[lo] : offsets[hi]]
                i = np.minimum(np.searchsorted(known, links), max(0, len(known) - 1))
                found = known[i] == links if len(known) else np.zeros(len(links), bool)
                worth = np.where(found, count[i] if len(known) else 0, 0)
                top = found & ((worth == best[links % n_b]) if len(known) else False)
                sums = [np.diff(np.append(0, np.cumsum(x))[at]) for x in (top, worth)]
                rest = np.append(0, np.cumsum(~found))[at].astype(np.int32)
                columns = [batch.column(0).slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in (np.diff(at), *sums)], pa.ListArray.from_arrays(pa.array(rest), pa.array(links[~found], pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_links", "n_best", "count_sum", "rest"])
                lo = hi

    return run


def align_tokens(docs: DataFrame, key: str, text: str, first: str = DEFAULT_A, second: str = DEFAULT_B, chunk_bytes: int = CHUNK_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    Both tokenizers encode a space and the text; where tokens of both end, the text is cut into groups. A link is a pair of tokens that end
    together, and an id pair's count is how many links of the whole corpus hold it.

    Short texts are encoded where they are read. A longer one is cut into byte ranges for each tokenizer at the first place where it joins nothing,
    so ranges of both need not begin together; tasks encode them to fragments, which a tree of shuffles with ``FAN`` neighbours at a step composes
    to the document. A stretch in which nothing can be cut is one range. Ids and counts of at most ``frequent`` pairs are broadcast (a power of two of their counts
    is the border); links of all other pairs meet their counts in a join, so every link counts.

    Null and empty texts, and those whose tokens do not give their bytes back, have no tokens: zeros and an empty digest. Rows
    repeated or with null keys are rows like any others; keys are integers; other columns are not looked at; an empty table gives none. A document's list of
    groups is one cell, so a text may have some 500 MB.
    """
    spark = docs.sparkSession
    files = tokenizer_files(spark, first, second)
    n_b = vocabulary_size(files.value[1])
    own = docs.select((F.monotonically_increasing_id() * 2).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    short = written(map_arrow(own.where(~large), _whole(files), _SHORT), "encoded")

    long_ = map_arrow(own.where(large).select((F.col("row") + 1).alias("row"), "key", "text"), _chunks(files, chunk_bytes), _CHUNK)
    parts = written(map_arrow(long_.repartition("row", "part"), _encode(files), _FRAGMENT), "fragments")
    kept = written(parts.groupBy("row").agg(F.min("ok").alias("good"), F.min("key").alias("key")), "kept")
    parts = parts.join(kept.where("good").select("row").hint("merge"), "row", "left_semi")
    links = [x.select("row", "links") for x in (short, parts)]
    infos = [short.drop("links"), kept.where("not good").select("row", "key", *[F.lit(0).cast("long").alias(n) for n in ("n_a", "n_b", "n_groups")], F.lit("").alias("groups_sha256"))]
    shipped(spark)
    most = parts.agg(F.max("parts")).first()[0] or 0
    while most:
        done = map_arrow(parts.where("parts = 1"), _finish(files), _SHORT.rpartition(",")[0])
        infos.append(done)
        if most == 1:
            break
        level = parts.where("parts > 1").groupBy("row", F.floor(F.col("part") / FAN)).applyInArrow(_compose(files), _FRAGMENT)
        parts, most = written(level, "fragments"), -(-most // FAN)
        links.append(parts.select("row", "links"))

    linked, info = links[0], infos[0]
    for x in links[1:]:
        linked = linked.unionByName(x)
    for x in infos[1:]:
        info = info.unionByName(x)
    counts = written(linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    # counts by powers of two: the lowest power above which at most so many pairs stand
    held, border = 0, 63
    for power, n in sorted(counts.groupBy((F.length(F.bin("count")) - 1).alias("e")).count().collect(), reverse=True):
        if held + n > frequent:
            break
        held, border = held + n, power
    often = counts.where(F.col("count") >= 1 << border) if held else counts.limit(0)
    often = often.toArrow().sort_by("pair")
    top = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))
    best = np.zeros(n_b, np.int64)
    for b, n in top.collect():  # one row for each id of the second tokenizer at most
        best[b] = n
    known = spark.sparkContext.broadcast((often["pair"].to_numpy(), often["count"].to_numpy(), best))
    judged = written(map_arrow(linked, _judge(known, n_b), "row long, n_links long, n_best long, count_sum long, rest array<long>"), "judged")
    rare = counts.where(F.col("count") < 1 << border) if held else counts
    rest = judged.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(rare.hint("merge"), "pair")
    rest = rest.withColumn("b", F.col("pair") % n_b).join(written(top, "best").hint("merge"), "b")
    rest = rest.select("row", F.lit(0).cast("long").alias("n_links"), F.when(F.col("count") == F.col("most"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    sums = judged.drop("rest").unionByName(rest).groupBy("row").agg(*[F.sum(n).alias(n) for n in ("n_links", "n_best", "count_sum")])
    out = info.join(sums.hint("merge"), "row", "left")
    filled = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_links", "n_best", "count_sum")]
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", *filled, "groups_sha256")
