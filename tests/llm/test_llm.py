"""The text operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from residua.llm import chat, decontaminate, forest, langid, mixing, queries, sharding, sketch, substring, tokencount, urlfilter
from residua.llm import words as W

KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, sig string, shard string"
LONG = "very long text with many words " * 4000
#: Nulls in every column, empty and very long texts, a repeated row, ties, and columns whose names the operators use inside.
ODD = [
    (1, None, "en", "a", 0, "x", "y", "z"), (2, "", None, None, 0, None, None, None), (3, "one two three", "en", "a", 13, "x", "y", "z"), (3, "one two three", "en", "a", 13, "x", "y", "z"),
    (None, "one two three four", "fr", "b", 18, "x", "y", "z"), (5, LONG, "de", "b", None, "x", "y", "z"), (6, LONG, "de", None, 5, "x", "y", "z"), (7, "12 34 !!", "en", "c", 8, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    assert differences(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) == ""


def test_words():
    texts = ["a b  c\td", None, "", "  x", "y ", "é a\x0bb", "ab"]
    for parts in (texts, texts[::-1]):
        buf, offsets = W.flat(pa.array(parts))
        w = W.words(buf, offsets)
        got = [[bytes(buf[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in itertools.pairwise(w.first)]
        assert got == [(t or "").split() for t in parts]
        by = {}
        for h, a, b in zip(w.hashes, w.starts, w.ends, strict=True):
            assert by.setdefault(bytes(buf[a:b]), h) == h
        assert len(set(by.values())) == len(by)


# 1


def brute_overlaps(doc, item):
    """The longest stretch over all diagonals by trying every start and end."""
    best = (0, 0)
    for d in range(-len(item) + 1, len(doc)):
        same = [0 <= i + d < len(doc) and item[i] == doc[i + d] for i in range(max(0, -d), min(len(item), len(doc) - d))]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                m = sum(same[i:j])
                if 5 * m >= 4 * (j - i):
                    best = max(best, (j - i, m))
    return best


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (5, 13, 20, 30)]
    docs = []
    for k in range(40):
        body = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        if k % 2:
            own = items[k % 4][:]
            for p in rng.sample(range(len(own)), len(own) // 8):
                own[p] = "Changed"
            at = rng.randrange(len(body))
            body[at:at] = own
        docs.append(body)
    d = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)] + [(9, None), (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_matched"]) for r in decontaminate.overlaps(d, "doc_id", "text", b).collect()}
    want = {}
    for i, x in enumerate(docs):
        for j, y in enumerate(items):
            n = brute_overlaps([t.lower() for t in x], y)
            if n[0] >= min(13, len(y)):
                want[i, j] = n
    assert got == want and len(want) >= 20
    blocks = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_matched"]) for r in decontaminate.overlaps(d, "doc_id", "text", b, index_tokens=25).collect()}
    assert blocks == got
    for limit in (decontaminate.INDEX_TOKENS, 25):
        left = {r[0] for r in decontaminate.drop_overlapping(d, "text", b, index_tokens=limit).select("doc_id").collect()}
        assert left == set(range(40)) - {i for i, _ in want}
        assert decontaminate.drop_overlapping(odd, "text", b, index_tokens=limit).count() == len(ODD) and decontaminate.overlaps(none, "doc_id", "text", b, index_tokens=limit).count() == 0
    assert decontaminate.drop_overlapping(odd, "text", b).count() == len(ODD) and decontaminate.drop_overlapping(none, "text", b).count() == 0
    assert decontaminate.overlaps(odd, "doc_id", "text", b.limit(0)).count() == 0


def test_masks():
    """Whatever a fifth of the tokens is changed, a mask fits between the changes."""
    for n in range(1, 24):
        masks = [m for m in (*decontaminate.MASKS, *decontaminate.SHORT_MASKS.get(n, ())) if len(m) <= n]
        for changed in itertools.combinations(range(n), n // 5):
            assert any(all(c == "0" or a + i not in changed for i, c in enumerate(m)) for m in masks for a in range(n - len(m) + 1)), (n, changed)


def test_one_change_in_five(spark):
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(4000)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (3, 5, 6, 7, 9, 10, 12, 13, 15, 16, 60, 500)]
    docs = []
    for y in items:
        n = len(y)
        for changed in [range(p, n, 5) for p in range(5)] + [rng.sample(range(n), n // 5) for _ in range(12)]:
            if len(changed) <= n // 5:
                docs.append([rng.choice(vocab) for _ in range(rng.randrange(9))] + ["new" if k in set(changed) else t for k, t in enumerate(y)] + ["end"])
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_matched"]) for r in decontaminate.overlaps(d, "doc_id", "text", b).collect()}
    want = {}
    for i, x in enumerate(docs):
        for j, y in enumerate(items):
            for k in range(-len(y) + 1, len(x)):
                a, e = max(0, -k), min(len(y), len(x) - k)
                same = np.array([t == u for t, u in zip(y[a:e], x[a + k : e + k], strict=True)])
                n = tuple(int(v[0]) for v in decontaminate.longest(same, np.array([len(same)]))[:2]) if same.any() else (0, 0)
                if n[0] >= min(13, len(y)):
                    want[i, j] = max(want.get((i, j), (0, 0)), n)
    assert got == want and {i for i, _ in want} == set(range(len(docs)))
    joined = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_matched"]) for r in decontaminate.overlaps(d, "doc_id", "text", b, index_tokens=0).collect()}
    assert joined == want
    assert decontaminate.drop_overlapping(d, "text", b).count() == 0


def test_items_and_longest(spark):
    rng = random.Random(2)
    items = [(i, ",".join(f"w{rng.randrange(99)}é" for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(7, "a-b c")] * 50 + [(99, "x." * 400)]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate._items(b, "item_id", "text").collect()
    assert sorted((r["id"], r["text"]) for r in rows) == sorted(set(items))
    for r in rows:
        assert r["n"] == len(decontaminate.tokens(*W.flat(pa.array([r["text"]]))).hashes)
    d = spark.createDataFrame([(1, "A b, c"), (None, "a B c"), (1, "A b, c")], "doc_id long, text string")
    for limit in (100, decontaminate.INDEX_TOKENS):
        assert sorted([tuple(r)[:2] for r in decontaminate.overlaps(d, "doc_id", "text", b, index_tokens=limit).collect()], key=str) == [(1, 7), (1, 7), (None, 7)]
    parts = [np.array([rng.random() < 0.75 for _ in range(rng.randrange(0, 40))], bool) for _ in range(200)]
    got = np.stack(decontaminate.longest(np.concatenate(parts), np.array([len(x) for x in parts])), axis=1).tolist()
    for (n, m, first), x in zip(got, parts, strict=True):
        every = [(j - i, int(x[i:j].sum()), -i) for i in range(len(x) + 1) for j in range(i, len(x) + 1) if 5 * int(x[i:j].sum()) >= 4 * (j - i)]
        best = max(every)
        assert (n, m) == best[:2] and (n == 0 or -first == best[2])


def test_repeated_tokens(spark):
    b = spark.createDataFrame([(1, "a " * 60), (2, "a b " * 30)], "item_id long, text string")
    d = spark.createDataFrame([(1, "a " * 100_000), (2, "b " * 12)], "doc_id long, text string")
    begun = time.time()
    got = {tuple(r) for r in decontaminate.overlaps(d, "doc_id", "text", b).collect()}
    assert got == {(1, 1, 0, 60, 60, 60)} and time.time() - begun < 60


def test_op1(spark, small):
    """All tokens of every document and item laid over each other, without seeds."""

    def cut(text):
        low = "".join(c.lower() if c.isascii() or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    items = {r["item_id"]: cut(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    places = {i: {} for i in items}
    for i, y in items.items():
        for k, t in enumerate(y):
            places[i].setdefault(t, []).append(k)
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        x = cut(r["text"])
        for i, y in items.items():
            need = min(13, len(y))
            on = Counter(k - j for k, t in enumerate(x) for j in places[i].get(t, ()))
            for d, hits in on.items():
                if 5 * hits >= 4 * need:
                    a = max(0, -d)
                    s = np.concatenate([[0], np.cumsum([1 if t == u else -4 for t, u in zip(y[a:], x[a + d :], strict=False)])])
                    n = np.where(s[None, :] >= s[:, None], np.arange(len(s))[None, :] - np.arange(len(s))[:, None], 0)
                    size = int(n.max())
                    if size >= need:
                        matched = max(int(s[e] - s[b] + 4 * size) // 5 for b, e in zip(*np.nonzero(n == size), strict=True))
                        want[r["doc_id"], i] = max(want.get((r["doc_id"], i), (0, 0)), (size, matched))
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_matched"]) for r in queries.op1_spaced_seed_decontamination(spark, small).collect()}
    assert got == want and want


# 2


def test_reply_trees(spark):
    rng = random.Random(8)
    nodes = []
    for t in range(4):
        n = rng.randrange(1, 25)
        for i in range(n):
            nodes.append((t, i, rng.randrange(i) if i else None, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "</s>[INST] ok [/INST]", "[\\INST]", "", None, "<<s>", "<\\\\/s>"]), float(rng.randrange(5))))
    nodes += [(9, 0, 1, "user", "x", 1.0), (9, 1, 0, "user", "y", 1.0)]  # a cycle
    nodes += [(8, 3, 77, "user", "orphan", None), (8, 3, 77, "user", "orphan", None), (None, 1, None, None, "null tree", None)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    paths = chat.reply_paths(df, "tree", "node", "parent", "score")
    out = chat.format_paths(paths, df, "tree", "node", "role", "text")
    got = {(r["tree"], r["leaf"]): r for r in out.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want, scores = {}, {}
    known = {(n[0], n[1]): n for n in nodes if n[0] != 9}
    parents = {(n[0], n[2]) for n in known.values()}
    for k in known:
        if k in parents:
            continue
        path, at = [], k
        while at in known:
            path.append(known[at])
            at = (at[0], known[at][2])
        want[k] = [(n[3] or "", n[4] or "") for n in path[::-1]]
        scores[k] = sum(n[5] or 0 for n in path)
    assert {k: [tuple(x) for x in r["turns"]] for k, r in got.items()} == want
    for k, r in got.items():
        assert r["loss"] == [x for role, x in want[k] if role == "assistant"]
        assert r["path_rank"] == 1 + sorted((-scores[j], j[1]) for j in scores if j[0] == k[0]).index((-scores[k], k[1]))
    assert chat.reply_paths(df.limit(0), "tree", "node", "parent", "score").count() == 0
    # a very long text, and columns named like those used inside; a long chain of replies
    odd = df.where("tree = 0").withColumns({"text": F.repeat(F.lit("[INST] long "), 50_000), **{c: F.lit("clash") for c in ("t", "n", "p", "w", "kt", "kn", "a", "up", "leaf", "formatted", "_turns", "turn")}})
    best = chat.reply_paths(odd, "tree", "node", "parent", "score", top=1)
    row = chat.format_paths(best, odd, "tree", "node", "role", "text").select(chat.parse_turns(F.col("formatted")).alias("turns")).first()
    assert {z["text"] for z in row["turns"]} == {"[INST] long " * 50_000}
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)], "tree long, node long, parent long, role string, text string, score double")
    one = chat.format_paths(chat.reply_paths(chain, "tree", "node", "parent", "score"), chain, "tree", "node", "role", "text").select(chat.parse_turns(F.col("formatted")).alias("turns")).collect()
    assert len(one) == 1 and [z["text"] for z in one[0]["turns"]] == [str(i) for i in range(300)]


def test_escape(spark):
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "x", "\n", "é"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


# 3


def test_ring(spark, odd, none):
    n = 1003
    df = spark.createDataFrame([(i, i % 7) for i in range(n)], "doc_id long, size long")
    rows = sharding.ring_shards(df, "doc_id", 8, ties=("size",)).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [125] * 5 + [126] * 3 and len({r["doc_id"] for r in rows}) == n
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(Counter(r["shard"] for r in rows)[s]))
    # most rows stand at the first shard clockwise of their own hash
    nodes = sharding.virtual_nodes(8, 64)
    first = {r["doc_id"]: sharding.clockwise(nodes, int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16), 8)[0] for r in rows}
    assert sum(first[r["doc_id"]] == r["shard"] for r in rows) > 0.7 * n
    loose = sharding.ring_shards(df, "doc_id", 8, slack=0.25).collect()
    assert max(Counter(r["shard"] for r in loose).values()) <= 158
    more = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, "doc_id", 9, slack=0.25).collect()}
    assert sum(more[r["doc_id"]] not in (r["shard"], 8) for r in loose) < 0.15 * n
    again = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df.orderBy(F.col("doc_id").desc()), "doc_id", 8, ties=("size",)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}
    assert sharding.ring_shards(none, "doc_id", 8).count() == 0
    plain = odd.drop("shard").withColumns({"_pos": F.lit(1), "_cell": F.lit(2), "__grid": F.lit(3)})
    assert sorted(Counter(r["shard"] for r in sharding.ring_shards(plain, "doc_id", 4).collect()).values()) == [2, 2, 2, 2]
    assert sharding.ring_shards(plain, "doc_id", 4).columns == [*plain.columns, "shard", "slot"]
    assert {(r["_pos"], r["_cell"], r["__grid"]) for r in sharding.ring_shards(plain, "doc_id", 4).collect()} == {(1, 2, 3)}
    assert {type(r["shard"]) for r in sharding.ring_shards(odd, "doc_id", 4).collect()} == {int}


def naive_ring(ids, shards, capacity, per_shard=64):
    """Row by row: knock at the next shard clockwise, in ring order, round after round."""
    at = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    nodes = [(at(f"shard-{s}-{i}"), s) for s in range(shards) for i in range(per_shard)]
    waiting = [(at(str(i)), i) for i in sorted(ids)]
    waiting.sort()
    walk = {}
    for p, i in waiting:
        seen = []
        for _, s in sorted(((q - p) % (1 << 32), s) for q, s in nodes):
            if s not in seen:
                seen.append(s)
        walk[i] = seen
    held, out, turn = [0] * shards, {}, 0
    while waiting:
        again = []
        for p, i in waiting:
            s = walk[i][turn]
            if held[s] < capacity[s]:
                out[i] = (s, held[s])
                held[s] += 1
            else:
                again.append((p, i))
        waiting, turn = again, turn + 1
    return out


def test_ring_against_a_naive_walk(spark, monkeypatch):
    ids = [i * 17 + 3 for i in range(701)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    moved = {}
    for shards in (8, 9):
        want = naive_ring(ids, shards, [701 // shards + (s < 701 % shards) for s in range(shards)])
        for bits in (2, 14, 20):  # the number of cells changes nothing
            monkeypatch.setattr(sharding, "LEAST_CELL_BITS", bits)
            got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.ring_shards(df, "doc_id", shards).collect()}
            assert got == want
        moved[shards] = {i: s for i, (s, _) in want.items()}
    # exact balance costs some movement beyond the ninth of the rows that must go; dealing by remainder would move eight ninths
    assert 1 / 9 <= sum(moved[8][i] != moved[9][i] for i in ids) / 701 < 0.4


def test_ring_hot_key(spark, monkeypatch):
    """A key with a third of the rows is ranked in parts; all other rows stand where the naive walk puts them, and the key's rows fill the same places."""
    rows = [(77, i) for i in range(300)] + [(i * 5 + 1000, 0) for i in range(600)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, size long")
    calm = sharding.ring_shards(df, "doc_id", 8, ties=("size",)).collect()
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    monkeypatch.setattr(sharding, "LEAST_CELL_BITS", 4)
    monkeypatch.setattr(sharding, "MOST_CELL_BITS", 8)
    hot = sharding.ring_shards(df, "doc_id", 8, ties=("size",)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in hot) == Counter(rows)
    one = lambda found: {(r["doc_id"], r["shard"], r["slot"]) for r in found}
    assert one(calm) == one(hot) and len(one(hot)) == len(rows)


def test_op3(spark, small):
    rows = queries.op3_consistent_hash_sharding(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)}
    assert sum(map(len, slots.values())) == len(rows) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(v == list(range(len(v))) for v in slots.values())


# 4


def test_families_are_learned():
    """Classes about three centres: each stands with its own centre's, however the centres are named; one and two classes are one family."""
    rng = np.random.default_rng(3)
    centres = rng.random((3, 60))
    names = ["x", "b", "m", "a", "z", "k"]
    means = [centres[i // 2] + 0.4 * rng.random(60) for i in range(6)]
    x, langs = np.concatenate([m + 0.05 * rng.normal(size=(30, 60)) for m in means]).astype(np.float32), [v for v in names for _ in range(30)]
    family = langid.families_of(x, langs)
    assert family == {"x": "b", "b": "b", "m": "a", "a": "a", "z": "k", "k": "k"}
    assert langid.families_of(x[:30], langs[:30]) == {"x": "x"} and langid.families_of(x[:60], langs[:60]) == {"x": "b", "b": "b"}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Model(x, langs)
    assert set(model.pairs) == {("b", "b", "x"), ("a", "a", "m"), ("k", "k", "z")} and np.mean(np.array(model.predict(x)[0]) == np.array(langs)) > 0.95


def test_language(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_hierarchical_language_id(spark, small).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    model = queries.learned_language(spark.read.parquet(f"{small}/documents.parquet"))
    got = {r["doc_id"]: r for r in langid.predict(odd, "text", model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[7]["lang_pred"] == "und" and got[1]["score"] == 0 and got[5]["lang_pred"] == "en"
    assert langid.predict(none, "text", model).count() == 0 and langid.fit(none, "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in langid.predict(odd, "text", None).collect()} == {"und"}
    one = langid.fit(odd.where("lang = 'en'"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.predict(odd.where("doc_id = 3"), "text", one).collect()} == {"en"}


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id", "concat('text ', id) AS text", "concat('l', id % 200) AS lang")
    monkeypatch.setattr(langid, "Model", lambda x, langs, families: len(x))
    assert langid.fit(rows, "id", "text", "lang") == 4000
    assert 250 <= langid.fit(rows, "id", "text", "lang", most_rows=400) <= 550
    assert 130 <= langid.fit(rows, "id", "text", "lang", most_rows=10) <= 270


def test_language_by_votes(spark, small):
    """Family by the largest margin, then a vote of each pair of its languages, row by row in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = queries.learned_language(docs)
    sure = lambda m: 1 / (1 + np.exp(-4.0 * min(8, max(-8, m))))
    told = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text"), "text", model).collect()}
    some = [r for r in docs.collect() if r["text"] and len(r["text"]) < 1500][:60]
    for r in some:
        raw = r["text"].encode()
        low = bytearray(raw.lower())
        for k in range(1, len(low)):
            if raw[k - 1] == 0xC3 and 0x80 <= raw[k] <= 0x9E and raw[k] != 0x97:
                low[k] = raw[k] + 32
        x = np.zeros(langid.TRIGRAMS + langid.BIGRAMS)
        letter = [97 <= c <= 122 or c >= 128 for c in low]
        for width, size, at in ((3, langid.TRIGRAMS, 0), (2, langid.BIGRAMS, langid.TRIGRAMS)):
            for k in range(len(low) - width + 1):
                if letter[k] or letter[k + 1]:
                    h = 0
                    for c, ok in zip(low[k : k + width], letter[k : k + width], strict=True):
                        h = (h * 0x01000193 + (c if ok else 32)) % (1 << 32)
                    x[at + ((h * 0x9E3779B1) % (1 << 32) >> (32 - (size - 1).bit_length()))] += 1
        x = np.sqrt(x)
        x /= max(np.linalg.norm(x), 1e-9)
        margins = [float(x @ w[:-1] + w[-1]) for w in model.first]
        family = model.families[int(np.argmax(margins))]
        score = sure(max(margins)) if len(model.families) > 1 else 1.0
        members = model.members[family]
        votes, trust = Counter(), Counter()
        for (f, a, b), w in model.pairs.items():
            if f == family:
                m = float(x @ w[:-1] + w[-1])
                votes[a if m > 0 else b] += 1
                trust[a] += sure(m)
                trust[b] += sure(-m)
        best = max(members, key=lambda v: votes[v] + trust[v] / (len(members) + 1))
        if len(members) > 1:
            score *= trust[best] / (len(members) - 1)
        got = told[r["doc_id"]]
        if any(map(str.isalpha, r["text"])):
            assert got["lang_pred"] == best and abs(got["score"] - score) < 1e-3, r["doc_id"]
    assert len(some) >= 30


# 5


def test_fingerprints(spark, odd, none):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choice("abc é\n") for _ in range(rng.choice([0, 1, 5, 40, 900])))) for i in range(120)]
    df = spark.createDataFrame(rows + [(1000, None)], "doc_id long, text string")
    texts = [t for _, t in rows] + [""]
    got = {r["doc_id"]: r for r in sketch.edited_fingerprints(df, "doc_id", "text", ranges=7).collect()}
    ids = [i for i, _ in rows] + [1000]
    prints = sketch.sketches(pa.array(texts))
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        after = (k + 1) % len(texts)
        edited = t[: len(t) - len(t) // 4] + texts[after][: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own = sketch.decode(r["fingerprint"])
        assert r["fingerprint"] == sketch.encode(prints[k]) and own.scale == prints[k].scale and np.array_equal(own.hashes, prints[k].hashes)
        assert r["near_edited"] == sketch.likeness(prints[k], sketch.sketches(pa.array([edited]))[0]) and r["near_next"] == sketch.likeness(prints[k], prints[after])

    def every(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        runs = W.byte_runs(raw)
        return {int(runs.runs(np.array([j]), np.array([min(j + 8, len(raw))]))[0]) >> 24 for j in range(max(1, len(raw) - 7))} if len(raw) else set()

    for t, p in zip(texts, prints, strict=True):
        kept = {h for h in every(t) if h < (1 << 40) // 16}
        assert (p.scale, set(p.hashes.tolist())) == ((16, kept) if len(kept) >= sketch.LEAST else (1, every(t)))
    for _ in range(300):  # a merged sketch is that of the union, at the coarser scale
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        merged = sketch.merge(prints[i], prints[j])
        union = {h for h in every(texts[i]) | every(texts[j]) if h < (1 << 40) // merged.scale}
        assert merged.scale == max(prints[i].scale, prints[j].scale) and set(merged.hashes.tolist()) == union
        assert sketch.likeness(prints[i], prints[j]) == sketch.likeness(prints[j], prints[i]) <= 1.0
        assert sketch.containment(prints[i], merged) in (0.0, 1.0)
    assert sketch.edited_fingerprints(odd, "doc_id", "text").count() == len(ODD) and sketch.edited_fingerprints(none, "doc_id", "text").count() == 0
    lone = sketch.edited_fingerprints(df.where("doc_id = 3"), "doc_id", "text").first()
    assert lone["near_next"] == 1.0
    # one key holds most rows: its texts are dealt to several ranges, and every row has a successor
    hot = spark.createDataFrame([(5, f"text number {i}") for i in range(300)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    parts = sketch.with_next(hot, "doc_id", "text", 6).where("ahead = 0").groupBy("part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 150
    rows = sketch.edited_fingerprints(hot, "doc_id", "text", 6).collect()
    assert len(rows) == 302 and {r["edited_sha256"] for r in rows if r["doc_id"] == 9} == {hashlib.sha256(b"lasf").hexdigest()}


def test_op5(spark, small):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = sketch.sketches(pa.array([t for _, t in docs]))
    got = {r["doc_id"]: r for r in queries.op5_scaled_fingerprints(spark, small).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = (k + 1) % len(docs)
        edited = t[: len(t) - len(t) // 4] + docs[after][1][: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["fingerprint"] == sketch.encode(prints[k])
        assert r["near_next"] == sketch.likeness(prints[k], prints[after]) and sketch.decode(r["edited_fingerprint"]).hashes.size
        # from the strings alone, hash by hash; and near the likeness of all shingles where there are many
        one, other = ((int(v[:2], 16), {int(v[j : j + 10], 16) for j in range(2, len(v), 10)}) for v in (r["fingerprint"], r["edited_fingerprint"]))
        limit = (1 << 40) >> max(one[0], other[0])
        a, b = ({h for h in s if h < limit} for _, s in (one, other))
        assert r["near_edited"] == (len(a & b) / len(a | b) if a | b else float(not one[1] and not other[1]))
        x, y = ({v.encode()[j : j + 8] for j in range(len(v.encode()) - 7)} for v in (t, edited))
        if len(x | y) > 3000:
            assert abs(r["near_edited"] - len(x & y) / len(x | y)) < 0.12


# 6


def test_token_trees(spark, odd, none):
    with open(tokencount.DEFAULT_RANKS, "rb") as f:
        enc = tokencount.encoder(f.read())
    rng = random.Random(9)
    parts = ["word", " ", "  ", "\n", "'s", "12", "é", "!?", " the", "x" * 40, "\t\n ", "ñandú"]

    def some(n):
        return "".join(rng.choice(parts) for _ in range(n))

    columns = "".join(f"{rng.randrange(10**6)} {rng.randrange(99)}\n" for _ in range(400))
    assert max(len(x) for x in tokencount.leaves(columns, 40)) < 80 and sum(len(enc.encode_ordinary(x)) for x in tokencount.leaves(columns, 40)) == len(enc.encode_ordinary(columns))
    for _ in range(150):
        text = some(rng.randrange(0, 400))
        own = tokencount.leaves(text, 40)
        assert "".join(own) == text and sum(len(enc.encode_ordinary(x)) for x in own) == len(enc.encode_ordinary(text))
        chars, tokens = tokencount.sums([len(x) for x in own] or [0]), tokencount.sums([len(enc.encode_ordinary(x)) for x in own] or [0])
        for _ in range(6):
            a = rng.randrange(0, len(text) + 2)
            text, _again = tokencount.apply_edit(text, chars, tokens, a, a + rng.randrange(0, 60), some(rng.randrange(0, 12)), lambda x: len(enc.encode_ordinary(x)))
            assert chars[1] == len(text) and tokens[1] == len(enc.encode_ordinary(text))
    # many insertions at one place, and texts without blanks: leaves are split again, so little is encoded for each
    text = some(3000)
    own = tokencount.leaves(text)
    chars, tokens = tokencount.sums([len(x) for x in own]), tokencount.sums([len(enc.encode_ordinary(x)) for x in own])
    most = 0
    for _ in range(200):
        text, again = tokencount.apply_edit(text, chars, tokens, 5000, 5000, " some more words", lambda x: len(enc.encode_ordinary(x)))
        most = max(most, again)
    assert chars[1] == len(text) and tokens[1] == len(enc.encode_ordinary(text)) and most < 2500
    chinese = "\u6211\u4eec\u8bf4\u8bdd\uff0c\u4f60\u542c\u3002" * 400
    assert max(map(len, tokencount.leaves(chinese))) < 300 and sum(len(enc.encode_ordinary(x)) for x in tokencount.leaves(chinese)) == len(enc.encode_ordinary(chinese))
    trees = tokencount.build_trees(odd, "doc_id", "text")
    edits = F.array(F.struct(F.lit(4).alias("start"), F.lit(6).alias("stop"), F.lit("new").alias("replacement")))
    rows = tokencount.apply_edits(trees.withColumn("edits", edits), "doc_id").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["token_tree"][1] == len(enc.encode_ordinary(r["text"])) and (len(r["text"]) < 2000 or r["chars_encoded"] < 1000)
    assert tokencount.build_trees(none, "doc_id", "text").count() == 0


def test_op6(spark, small):
    with open(tokencount.DEFAULT_RANKS, "rb") as f:
        enc = tokencount.encoder(f.read())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op6_edit_aware_token_counts(spark, small).collect():
        text, n = docs[r["doc_id"]], len(docs[r["doc_id"]])
        assert r["tokens_before"] == len(enc.encode_ordinary(text))
        text = text[: n // 5] + text[n // 5 + 7 :]
        text = text[: n // 2] + " edited text 42" + text[n // 2 :]
        text = text[:n] + "\nThe end." + text[n + 8 :]
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(enc.encode_ordinary(text)) and r["n_chars"] == len(text)


# 7


def test_urls(spark):
    urls = ["http://a.Example.ORG/en/12?x", "https://example.org/es/", "http://example.org", "ftp://fr.com/fr/a", "http://x.com/de/#", "no scheme", None, "", "a://b://c.com/de/", "http://notexample.org/en/1", "http://org/", "http://example.org:80/es/", "http://example.org/en/1"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, rules).collect()}
    joined = {r["page_id"]: r for r in urlfilter.filter_urls(df, rules, broadcast_rules=0).collect()}
    assert got == joined and len(got) == len(urls) + 2
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2]), u
    upper = spark.createDataFrame([("Example.org", "/", "block")], "host string, path string, verdict string")
    assert {r["page_id"] for r in urlfilter.filter_urls(df, upper).where("verdict = 'block' and rule = 'example.org/'").collect()} == {0, 1, 12, 13, 14}
    long = spark.createDataFrame([(1, "http://example.org/es/" + "x/" * 50_000), (2, "http://" + "a." * 300 + "com/de/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(long, rules).collect()} == {1: "block", 2: "block"}
    begun = time.time()
    deep = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/de/"), (2, "http://" + "." * 100_000 + "org/"), (3, "http://" + "a." * 100_000 + "net/")], "page_id long, url string")
    many = rules.unionByName(spark.createDataFrame([("a." * 20_000 + "com", "/d", "allow")], "host string, path string, verdict string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(deep, many).collect()}
    assert got == {1: ("a." * 20_000 + "com/d", "allow"), 2: ("org/", "allow"), 3: (None, "allow")} and time.time() - begun < 60
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


# 8


def test_near_duplicates(spark, odd, none):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:
        for _ in range(3):
            c = b[:]
            for p in rng.sample(range(len(c)), max(1, len(c) // rng.choice([12, 20, 40]))):
                c[p] = "new"
            texts.append(" ".join(c).title())
    texts += texts[:5] + [None, "", " "]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set()))
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        before = low[:]
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    got = {r["doc_id"]: r for r in forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == low
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (low[i] == i) for i in range(len(texts)))
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in forest.near_duplicates(odd, "doc_id", "text").collect()}
    assert rows == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True)}
    assert forest.near_duplicates(none, "doc_id", "text").count() == 0


def test_near_duplicates_of_repeated_keys(spark):
    """Rows of one key are one document with all their sets."""
    rng = random.Random(5)
    x, y = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(25)) for _ in range(12)]
    many = [(rng.randrange(20), rng.choice(base) + rng.choice(["", " more", " "])) for _ in range(60)]
    for rows in ([(5, x), (7, x), (7, y), (9, y)], [(7, x), (7, y), (9, y + " z"), (6, x + " q")], many):
        sets = [(i, {tuple(w[k : k + 2]) for k in range(len(w) - 1)}) for i, w in ((i, t.split()) for i, t in rows)]
        low = {i: i for i, _ in rows}
        for _ in rows:
            for (i, s), (j, t) in itertools.combinations(sets, 2):
                if 100 * len(s & t) >= 80 * len(s | t):
                    low[i] = low[j] = min(low[i], low[j])
        got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
        assert len(got) == len(rows) and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, c, i == c) for i, c in low.items()}


def test_crowded_regions(spark, monkeypatch):
    """Many texts under one template, in regions that are ordered in parts and compared in several small blocks."""
    monkeypatch.setattr(forest, "REGION", 16)
    monkeypatch.setattr(forest, "BLOCK", 8)
    monkeypatch.setattr(forest, "BLOCK_SHINGLES", 2000)
    rng = random.Random(41)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        own = [f"u{rng.randrange(10**6)}" for _ in range(25)]
        for _ in range(4):
            w = template + own
            w[rng.randrange(60)] = "changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (t.split() for t in texts)]
    low = list(range(len(texts)))
    for _ in range(6):
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[i] = low[j] = min(low[i], low[j])
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == low and len(set(low)) == 30


def test_pairs_of_a_block():
    """The prefix filter of a block loses no pair: sets of many likenesses, equal ones and single shingles, under several thresholds."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (1, 1, 2, 5, 9, 40, 200)]
    for base in list(sets):
        for share in (0, 0.02, 0.1, 0.15, 0.3):
            kept = base[rng.random(len(base)) >= share]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 62, round(share * len(base)), dtype=np.uint64))))
    common = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
    sets += [np.unique(np.append(common, rng.integers(0, 1 << 62, n, dtype=np.uint64))) for n in (5, 10, 15, 20, 40, 80)]
    sets = [s for s in sets if len(s)]
    asks, comps = rng.random(len(sets)) < 0.5, rng.integers(0, 20, len(sets))
    for percent in (50, 80, 95, 100):
        want = set()
        for i, j in itertools.product(np.flatnonzero(asks).tolist(), np.flatnonzero(~asks).tolist()):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comps[i] != comps[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
        assert {(i, j) for i, found in forest.alike_pairs(sets, asks, comps, percent) for j in found.tolist()} == want
        assert want or percent > 80


def test_common_values_of_tails(spark):
    values = [(0x1111222233334444, 0x1111222233334444, 4), (0x1111222233334444, 0x1111222233334445, 3), (0x1111222233334444, 0x1111222233330444, 3), (0x1111222233334444, 0x1111222203334444, 2), (0x1111222233334444, 0x1111022233334444, 1), (1, -1, 0), (-1, -1, 4)]
    rows = spark.createDataFrame(values, "x long, y long, want int")
    assert rows.where(forest._common(F.col("x"), F.col("y")) != F.col("want")).count() == 0


# 9


def test_mixing(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), rng.randrange(0, 40)) for i in range(3000)] + [(9000 + i, "tiny", 1) for i in range(3)] + [(9999, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_rates(df, "doc_id", "source", "size").collect()
    total = sum(r[2] for r in rows)
    assert len(got) == len(rows) and abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1e-6 * total
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        taken, target = sum(r["copies"] * r["size"] for r in own), own[0]["target"]
        assert target <= 3 * own[0]["source_size"] + 1e-9 and abs(taken - target) <= max(0.01 * target, 40)
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1 and max(r["copies"] for r in own) <= 3
    again = mixing.mix_rates(df.orderBy(F.rand(1)), "doc_id", "source", "size").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    sized = lambda d: d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    copies = mixing.mix_rates(sized(odd), "doc_id", "source", "size")
    assert copies.count() == len(ODD) and mixing.emit_copies(odd, "doc_id", "source", mixing.source_rates(sized(odd), "doc_id", "source", "size")).columns == odd.columns
    clash = odd.withColumns({"target": F.lit(1), "_whole": F.lit(9), "_source": F.lit("q"), "_n": F.lit(3)})
    rates = mixing.source_rates(sized(odd), "doc_id", "source", "size")
    emitted = mixing.emit_copies(clash, "doc_id", "source", rates)
    assert emitted.columns == clash.columns and emitted.count() == mixing.emit_copies(odd, "doc_id", "source", rates).count() and {r["_whole"] for r in emitted.collect()} <= {9}
    # keys that several sources have, and repeated rows: each row as often as its own source says
    rows = [(i % 400, "abc"[i % 3], 5 + i % 7) for i in range(1500)] + [(1, "a", 6)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    want = Counter()
    for r in mixing.mix_rates(df, "doc_id", "source", "size").collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    rates = mixing.source_rates(df, "doc_id", "source", "size")
    limit, mixing.BROADCAST_SOURCES = mixing.BROADCAST_SOURCES, 0
    try:
        apart = Counter(map(tuple, mixing.emit_copies(df, "doc_id", "source", rates).collect()))
    finally:
        mixing.BROADCAST_SOURCES = limit
    assert Counter(map(tuple, mixing.emit_copies(df, "doc_id", "source", rates).collect())) == apart == +want
    assert mixing.mix_rates(sized(none), "doc_id", "source", "size").count() == 0


# 10


def brute_repeats(docs, window):
    seen, out = {}, {}
    for i, t in docs:
        w = (t or "").split()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if i is not None:
                seen[k] = min(seen.get(k, i), i)
    for n, (i, t) in enumerate(docs):
        w = (t or "").split()
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out[n] = (i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings(spark, odd, none):
    rng = random.Random(21)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    docs = []
    for i in range(90):
        body = [x for _ in range(rng.randrange(0, 5)) for x in (rng.choice(pool) if rng.random() < 0.7 else [rng.choice("abcdefgh") for _ in range(20)])]
        docs.append((rng.randrange(70) if i % 9 else None, " ".join(body) if body else None))
    docs += [(100, "a " * 200), (101, "a " * 150), (102, "b a " * 80), (103, "a b " * 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window, gram in ((10, 3), (50, 12)):
        got = substring.drop_repeats(df, "doc_id", "text", window, gram).collect()
        want = brute_repeats(docs, window)
        key = lambda x: str(x)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(want.values(), key=key)
    own = {}
    for i, t in docs:
        own.setdefault(i, []).append((t or "").split())
    for window, gram in ((100, 12), (70, 30)):  # windows longer than any earlier packing of their number allowed
        twice = [*docs, (200, " ".join(rng.choice("xyz") for _ in range(400)))]
        twice.append((201, twice[-1][1]))
        got = substring.drop_repeats(spark.createDataFrame(twice, "doc_id long, text string"), "doc_id", "text", window, gram).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == sorted(brute_repeats(twice, window).values(), key=str)
        assert [tuple(f) for r in got if r["doc_id"] == 201 for f in r["factors"]] == [(0, 400, 200, 0)]
        for r in got:  # every factor is where it says it is, in a smaller document
            for f in r["factors"]:
                assert f["words"] >= window and f["ref"] < r["doc_id"]
                if len(own.get(r["doc_id"], ())) == 1 and r["doc_id"] < 200:
                    mine = own[r["doc_id"]][0][f["first"] : f["first"] + f["words"]]
                    assert any(mine == x[f["ref_first"] : f["ref_first"] + f["words"]] for x in own[f["ref"]])
    text = " ".join(rng.choice("pqrs") for _ in range(300))
    again = spark.createDataFrame([(300, text + " t " * 60)] + [(301, text + " u")] * 40 + [(301, "v " + text)] * 2, "doc_id long, text string")
    got = substring.drop_repeats(again, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], [tuple(f) for f in r["factors"]]) for r in got) == sorted(
        [(300, 360, 0, [])] + [(301, 301, 300, [(0, 300, 300, 0)])] * 40 + [(301, 301, 300, [(1, 300, 300, 0)])] * 2
    )
    rows = {(r["doc_id"], r["n_removed"]) for r in substring.drop_repeats(odd, "doc_id", "text").collect()}
    assert (6, 24000) in rows and (5, 0) in rows and (3, 0) in rows and (1, 0) in rows
    assert substring.drop_repeats(none, "doc_id", "text").count() == 0


# the pipeline


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES:
        out = P.written(stage(spark, kept, small), name)
        if name == "minhash_near_dedup":
            before = {r["doc_id"]: r["text"] for r in kept.collect()}
            sets = {}
            for i, t in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
                sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            low = {i: i for i in sets}
            pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            for _ in range(10):
                for a, b in pairs:
                    low[a] = low[b] = min(low[a], low[b])
            assert {r["doc_id"] for r in out.collect()} == {i for i in low if low[i] == i} and pairs
        if name == "benchmark_decontamination":
            hit = {r["doc_id"] for r in decontaminate.overlaps(kept, "doc_id", "text", spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.collect()} - hit and hit
        if name == "language_id":
            # what is told of each whole text decides, whatever the row's other columns say
            told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(kept.select("doc_id", "text"), "text", queries.learned_language(kept)).collect()}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in kept.collect() if told[r["doc_id"]][0] != "und" and told[r["doc_id"]][1] >= P.LEAST_SCORE)
        if name == "source_mixing":
            sizes = {}
            for r in kept.collect():
                sizes.setdefault(r["source"], []).append((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            weigh = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
            total, held = sum(n for x in sizes.values() for _, n in x), set()
            while True:  # water-filling: who would be above three times its size is held there, the rest share what is left
                left = total - sum(3 * sum(n for _, n in sizes[s]) for s in held)
                level = left / max(1, sum(weigh[s] for s in names if s not in held))
                more = {s for s in names if s not in held and level * weigh[s] > 3 * sum(n for _, n in sizes[s])}
                if not more:
                    break
                held |= more
            want = Counter()
            for s, rows in sizes.items():
                size = sum(n for _, n in rows)
                target = min(3.0 * size, level * weigh[s]) if s not in held else 3.0 * size
                rate = target / size if size else 0.0
                whole, rest = int(rate), rate - int(rate)
                ab = {i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), int(hashlib.md5(str(i).encode()).hexdigest()[8:16], 16) | 1) for i, _ in rows}
                hit = lambda i, k: (ab[i][0] + k * ab[i][1]) % (1 << 32) < rest * (1 << 32)  # noqa: E731,B023
                seed = min(range(mixing.SEEDS), key=lambda k: (abs(whole * size + sum(n for i, n in rows if hit(i, k)) - target), k))
                for i, _ in rows:
                    want[i] += whole + hit(i, seed)
            assert Counter(r["doc_id"] for r in out.collect()) == +want
        if name == "sharding":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in kept.collect())
            for s in range(P.SHARDS):
                own = [r["slot"] for r in out.collect() if r["shard"] == s]
                assert sorted(own) == list(range(len(own)))
        if name != "sharding":
            assert out.columns == docs.columns
        kept = out
    assert max(Counter(r["shard"] for r in kept.collect()).values()) - min(Counter(r["shard"] for r in kept.collect()).values()) <= 1


def test_pipeline_odd_tables(spark, odd, none):
    """Each stage on nulls in every column, empty and very long texts, repeated rows, no rows, and columns with names used inside."""
    import corpus_pipeline as P

    clash = odd.withColumns({c: F.lit("clash") for c in ("_row", "_rank", "_source", "_seed", "s1", "lang_pred", "score", "component_id", "_pos", "slot")})
    for docs in (odd, clash, none):
        for name, stage in P.STAGES:
            if name == "benchmark_decontamination":
                out = P.decontaminate.drop_overlapping(docs, "text", spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string"))
            else:
                out = stage(spark, docs, "")
            rows = out.collect()
            if name != "sharding":
                assert out.columns == docs.columns
            assert len(rows) <= 3 * len(ODD) and (docs is not none or not rows)
    kept = {r["doc_id"] for r in P.language(spark, odd, "").collect()}
    assert kept <= {3, None, 5, 6} and 5 in kept


def test_pipeline_repeated_rows(spark):
    import corpus_pipeline as P

    rng = random.Random(31)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4))
    rows = [(7, a, "x"), (7, a, "x"), (7, b, "x"), (9, a, "y"), (5, b + " more", "z"), (None, c, "x"), (None, c, "y"), (None, a, "x"), (11, d, "x"), (None, d, "x"), (8, "", "x"), (12, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(7, a), (5, b + " more"), (None, c), (11, d), (8, ""), (12, None), (None, "")])
