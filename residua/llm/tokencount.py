"""Edit-aware token counts: a segment tree of pre-token groups for each document."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.ship import map_arrow

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A leaf ends at the first safe cut after so many characters.
LEAF_CHARS = 256
#: A pre-token always ends between a visible character and a blank that a letter follows, between a mark that is no apostrophe and a letter, and between a letter, a number or a
#: mark and a new line, whatever stands around.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\p{L})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})|(?<=[\p{L}\p{N}\p{P}\p{S}])(?=\n)")
_ENCODERS: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's bytes, built once in each process."""
    import tiktoken

    key = hashlib.sha256(ranks).digest()
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in groups of whole pre-tokens; encoding them one by one gives the tokens of the whole. A stretch without a safe cut, such as letters without
    blanks or marks, is one group however long it is."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]] if at < len(text) else out


def sums(counts: list[int]) -> list[int]:
    """A segment tree: sums[1] is the root, sums[width + i] leaf i, width the next power of two."""
    width = 1
    while width < len(counts):
        width *= 2
    tree = [0] * width + counts + [0] * (width - len(counts))
    for i in range(width - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def update(tree: list[int], leaf: int, value: int) -> None:
    """Set a leaf and the sums above it."""
    i = len(tree) // 2 + leaf
    change = value - tree[i]
    while i:
        tree[i] += change
        i //= 2


def find(tree: list[int], at: int) -> tuple[int, int]:
    """(leaf, first character) of the leaf with character ``at`` in a tree of lengths; past the end, the last one that has any."""
    i, before, width = 1, 0, len(tree) // 2
    at = min(at, tree[1] - 1)
    while i < width:
        i *= 2
        if at - before >= tree[i]:
            before += tree[i]
            i += 1
    return i - width, before


def apply_edit(text: str, chars: list[int], tokens: list[int], start: int, stop: int, new: str, count) -> tuple[str, int]:
    """The edited text; both trees are brought up to date. Also how many characters were encoded again.

    Only the leaves that the edit touches are encoded, together with a neighbour whose cut stands within two
    characters of the edit, since a cut depends on the visible character before it and the letter after its blank. What comes of them
    fills their places again, leaf by leaf; where it needs more places than there are and would make one leaf four times as long as usual, new leaves are put
    in and the sums are added up anew, without encoding anything else.
    """
    n = len(text)
    start = min(max(start, 0), n)
    stop = min(max(stop, start), n)
    changed = text[:start] + new + text[stop:]
    if n == 0:
        first = last = begin = end = 0
    else:
        first, begin = find(chars, max(0, start - 2))
        last, last_begin = find(chars, min(n - 1, stop + 1))
        end = last_begin + chars[len(chars) // 2 + last]
    region = changed[begin : end + len(new) - (stop - start)]
    parts = leaves(region)
    places = last + 1 - first
    own = [(len(x), count(x)) for x in parts] + [(0, 0)] * (places - len(parts))
    rest = own[places - 1 :]
    if len(own) <= places or sum(x for x, _ in rest) <= 4 * LEAF_CHARS:
        own = [*own[: places - 1], (sum(x for x, _ in rest), sum(t for _, t in rest))]
        for i, (x, t) in enumerate(own):
            update(chars, first + i, x)
            update(tokens, first + i, t)
    else:
        for tree, part in ((chars, 0), (tokens, 1)):
            width = len(tree) // 2
            tree[:] = sums([*tree[width : width + first], *[x[part] for x in own], *tree[width + last + 1 :]])
    return changed, len(region)


def _build(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for b in batches:
            for lo, hi, _, _ in W.pieces(b.column(0)):
                part = b.slice(lo, hi - lo)
                chars, tokens = [], []
                for text in part.column(0).to_pylist():
                    own = leaves(text or "")
                    chars.append(sums([len(x) for x in own] or [0]))
                    tokens.append(sums([len(encode(x)) for x in own] or [0]))
                rows = [pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens)]
                yield pa.RecordBatch.from_arrays([*part.columns, *rows], [*part.schema.names, "char_tree", "token_tree"])

    return run


def _edit(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for b in batches:
            for lo, hi, _, _ in W.pieces(b.column(0)):
                rows = b.slice(lo, hi - lo).to_pylist()
                for r in rows:
                    text, again, r["tokens_before"] = r["text"] or "", 0, r["token_tree"][1]
                    for e in r["edits"] or []:
                        text, k = apply_edit(text, r["char_tree"], r["token_tree"], e["start"], e["stop"], e["replacement"] or "", lambda x: len(encode(x)))
                        again += k
                    r["text"], r["chars_encoded"] = text, again
                names = [n for n in b.schema.names if n != "edits"]
                cols = [pa.array([r[n] for r in rows], b.schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r[n] for r in rows], pa.int64()) for n in ("tokens_before", "chars_encoded")]], [*names, "tokens_before", "chars_encoded"])

    return run


def _ranks(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


TREES = "char_tree array<int>, token_tree array<int>"


def build_trees(docs: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(text, key, char_tree, token_tree): for each row the segment trees of characters and tokens over its leaves; their
    second entry is the document's total. The vocabulary file is read on the driver and broadcast. Null text is empty; keys are integers or null; other
    columns are dropped; repeated rows are each built; an empty table gives none."""
    own = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("key"))
    return map_arrow(own, _build(_ranks(docs.sparkSession, ranks_path)), f"text string, key long, {TREES}").withColumnRenamed("key", key)


def apply_edits(trees: DataFrame, key: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(text, key, char_tree, token_tree, tokens_before, chars_encoded) after the ``edits`` of each row, in order.

    An edit (start, stop, replacement) replaces the code points from start up to stop, positions in the text as the
    edits before left it; positions beyond the text are moved to its end, null edits change nothing, a null replacement is empty. Repeated rows are each
    edited; an empty table gives none; columns beyond those of ``build_trees`` and ``edits`` are dropped.
    """
    own = trees.select("text", F.col(key).alias("key"), "char_tree", "token_tree", F.col("edits").cast("array<struct<start:bigint,stop:bigint,replacement:string>>").alias("edits"))
    return map_arrow(own, _edit(_ranks(trees.sparkSession, ranks_path)), f"text string, key long, {TREES}, tokens_before long, chars_encoded long").withColumnRenamed("key", key)
