"""The count-vector join, lexical search and tokenizer alignment against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import KIND, ODD

from residua.llm import countjoin, crosstoken, lexical


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# 11


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_classes(rows, size, percent):
    sets = [(k, shingles(t, size)) for k, t in rows]
    comp = {k: k for k, _ in rows if k is not None}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted(((k, len(s), comp.get(k)) for k, s in sets), key=repr)


def near_texts(rng, families=12, most=9):
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 200]))]
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own).replace("w1", "W1"))
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_classes(spark, block, monkeypatch):
    monkeypatch.setattr(countjoin, "BLOCK", block)
    rows = near_texts(random.Random(block))
    got = countjoin.jaccard_classes(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute_classes(rows, 4, 85)
    same = Counter(frozenset(shingles(t, 4)) for _, t in rows)
    assert {r["k"]: r["n_copies"] for r in got} == {k: same[frozenset(shingles(t, 4))] - 1 for k, t in rows}


def test_many_copies_of_one_text(spark):
    """A third of all rows are copies, another third near copies that differ in one word."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(300)]
    rows += [(600 + i, " ".join(f"{i}-{rng.randrange(9)}" for _ in range(30))) for i in range(300)]
    got = {r["k"]: r["component_id"] for r in countjoin.jaccard_classes(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {k: 0 if k < 600 else k for k, _ in rows}


def test_count_tree_leaves_what_the_bound_leaves():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, (6, 400))
    sets = [np.unique(np.append(base[i % 6][: rng.integers(350, 400)], rng.integers(0, 1 << 40, rng.integers(0, 60)))).astype(np.uint64) for i in range(150)]
    sizes = np.array([len(s) for s in sets])
    vectors = countjoin.matrix([countjoin.vector_of(countjoin.count_vector(s)) for s in sets])
    tree, other = countjoin.CountTree(vectors[:100], sizes[:100]), countjoin.CountTree(vectors[100:], sizes[100:])
    i, j = tree.join(other, 85)
    both = np.minimum(vectors[:100, None], vectors[None, 100:]).sum(axis=2)
    want = {(a, b) for a, b in zip(*np.nonzero(185 * both >= 85 * (sizes[:100, None] + sizes[None, 100:])), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    linked = {(a, b - 100) for a in range(100) for b in range(100, 150) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= want
    rough = countjoin.coarse(vectors)
    assert rough.shape[1] * countjoin.COARSE == vectors.shape[1]
    i, j = countjoin.CountTree(rough[:100], sizes[:100]).join(countjoin.CountTree(rough[100:], sizes[100:]), 85)
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_jaccard_odd(spark, odd, none):
    got = countjoin.jaccard_classes(odd.withColumnRenamed("id", "region"), "doc_id", "text").collect()
    assert sorted((r[:3] for r in got), key=repr) == brute_classes([(r[0], r[1]) for r in ODD], 4, 85)
    assert countjoin.jaccard_classes(none, "doc_id", "text").collect() == []


# 12


def brute_search(docs, queries, keep):
    terms = [(k, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for k, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item in sorted({q for q, _ in queries if q is not None}):
        asked = {x for q, t in queries if q == item for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))}
        scored = []
        for k, own in terms:
            tf = Counter(own)
            m = 10 + (90 * len(own) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in asked if tf[x])
            if s > 0 and k is not None:
                scored.append((-s, k))
        out += [(item, i, k, -s) for i, (s, k) in enumerate(sorted(scored)[:keep], 1)]
    return out


@pytest.mark.parametrize("a_pass", [1 << 20, 7])
def test_search(spark, a_pass):
    rng = random.Random(8)
    vocab = [f"w{i}" if i % 3 else f"W{i}é" for i in range(60)]
    pick = lambda n: " -".join(vocab[min(int(rng.expovariate(0.12)), 59)] for _ in range(n))
    docs = [(i, pick(rng.choice([0, 1, 5, 40, 300]))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(60)] + [(None, "w1 w2"), (7, "w1 w2 w4"), (900, None), (901, "!! ??")]
    queries = [(q, pick(rng.choice([1, 4, 12, 30]))) for q in range(12)] + [(3, "w59 w58"), (None, "w1"), (20, None), (21, "unseen")]
    d, q = spark.createDataFrame(docs, "k long, t string").repartition(3), spark.createDataFrame(queries, "q long, t string")
    got = sorted(tuple(r) for r in lexical.search(d, "k", "t", q, "q", "t", keep=5, terms_a_pass=a_pass).select("q", "rank", "k", "score").collect())
    assert got == brute_search(docs, queries, 5)


def test_block_skips_nothing_that_counts():
    """One block with short and long lists: the best by any threshold are those of full sums."""
    rng = np.random.default_rng(2)
    n, terms = 3000, 12
    keep = rng.random((terms, n)) < np.array([0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.001])[:, None]
    term, doc = np.nonzero(keep)
    score = rng.integers(1, 1000, len(doc)) * (term + 1)
    block = lexical.Block(doc, term, score, n, terms)
    full = np.bincount(doc, score, n).astype(np.int64)
    want = lexical.top(np.arange(n), full, 10)
    for floor in (0, int(full[want[-1]]), int(full[want[0]])):
        docs, scores = block.best(np.arange(terms), 10, floor)
        assert (full[docs] == scores).all()
        assert {d for d in want.tolist() if full[d] >= floor} <= set(docs.tolist())
        assert len(docs) < n / 4


def test_search_odd(spark, odd, none):
    asked = odd.withColumnRenamed("doc_id", "q").withColumnRenamed("sig", "doc_id").withColumnRenamed("lang", "item")
    docs = odd.withColumnRenamed("lang", "item").withColumnRenamed("source", "terms")
    got = sorted(tuple(r) for r in lexical.search(docs, "doc_id", "text", asked, "q", "text", keep=3).select("q", "rank", "doc_id", "score").collect())
    rows = [(r[0], r[1]) for r in ODD]
    assert got == brute_search(rows, rows, 3) and got
    for docs, asked in ((none, odd), (odd, none), (none, none)):
        assert lexical.search(docs, "doc_id", "text", asked.withColumnRenamed("doc_id", "q"), "q", "sig").collect() == []


# 13

TEXTS = [
    "Hello world", None, "", " ", "  two  blanks ", "<|endoftext|> and </s><s> are text", "a▁b has the mark", "tabs\tand\nnew\n\nlines\r\n", "naïve ciónñ ñasquera", "日本語のテキスト、漢字。", "emoji 👩‍👩‍👧 ok",
    "12 345\n6789\n\n10", "a" * 700, "don't we'll I'm 'quoted'", "x\x00y\x07", "nbsp and thin ﬁ Ⅳ ㍿ é", " lead", "trail ", "中" * 400 + " " + "x,y;z " * 60, "word " * 300 + "end", "word " * 300 + "a▁b", "1\n" * 500, "ab" * 300 + "\n" + "tail of it " * 40,
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(crosstoken.DEFAULT_A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=crosstoken.DEFAULT_B)
    table = crosstoken.byte_alphabet()
    rows, links = [], []
    for text in texts:
        want = b" " + (text or "").encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
        groups, own, i, j = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(at) + 1, ends[1].index(at) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            own.append((a[k - 1], b[m - 1]))
            i, j = k, m
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(x for y in links for x in y)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r[:3], len(y), sum(count[x] == best[x[1]] for x in y), sum(count[x] for x in y), r[3]) for r, y in zip(rows, links, strict=True)]


@pytest.mark.parametrize(("chunk", "frequent"), [(1 << 16, 1 << 20), (40, 1 << 20), (100, 6), (1 << 16, 0)])
def test_alignment(spark, chunk, frequent):
    texts = [*TEXTS, *TEXTS[:4]]
    docs = spark.createDataFrame([(i if i != 3 else None, x) for i, x in enumerate(texts)], "k long, t string").repartition(3)
    got = crosstoken.align_tokens(docs, "k", "t", chunk_bytes=chunk, frequent=frequent).collect()
    want = [(i if i != 3 else None, *r) for i, r in enumerate(brute_alignment(texts))]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_fragments_compose_in_any_order():
    with open(crosstoken.DEFAULT_A, "rb") as a, open(crosstoken.DEFAULT_B, "rb") as b:
        pair = crosstoken.Pair(a.read(), b.read())
    rng = random.Random(6)
    text = "The naïve ciónñ of unbelievably-long words,\nñasquera 1234 and 日本語 text. " * 4
    ids_a, ids_b = pair.encode_a(" " + text), np.array(pair.encode_b(text, True))
    ends = np.cumsum(pair.lengths[ids_a]), np.cumsum(pair.lengths[ids_b + pair.n_a])
    whole = crosstoken.fragment(pair, crosstoken.Tokens(ids_a, ends[0], ids_b, ends[1]))
    for _ in range(60):
        # both streams are cut at places of their own, as byte ranges of two tokenizers are
        n = rng.randrange(2, 9)
        i, j = (sorted(rng.randrange(len(x) + 1) for _ in range(n - 1)) for x in (ids_a, ids_b))
        near = [min(range(len(ids_b)), key=lambda k, e=(ends[0][x - 1] if x else 0): abs(ends[1][k] - e)) for x in i]
        j = sorted(near) if rng.random() < 0.5 else j
        cut = [np.split(x, y) for x, y in ((ids_a, i), (ends[0], i), (ids_b, j), (ends[1], j))]
        parts = [crosstoken.fragment(pair, crosstoken.Tokens(*x)) for x in zip(*cut, strict=True)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [crosstoken.compose(pair, parts[k], parts[k + 1])]
        made = parts[0]
        assert (made.closed, made.groups, made.cut) == (whole.closed, whole.groups, whole.cut)
        assert sorted(made.links.tolist()) == sorted(whole.links.tolist())
        assert all((x == y).all() for x, y in zip((*made.head, *made.tail), (*whole.head, *whole.tail), strict=True))


def test_cuts_are_where_nothing_joins():
    with open(crosstoken.DEFAULT_A, "rb") as a, open(crosstoken.DEFAULT_B, "rb") as b:
        pair = crosstoken.Pair(a.read(), b.read())
    for text in filter(None, TEXTS):
        if "▁" in text:
            continue
        a, b = crosstoken.cuts(pair, text, 7)
        at, bt = [0, *a, len(text)], [0, *b, len(text)]
        got_a = np.concatenate([pair.encode_a((" " if i == 0 else "") + text[x:y]) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))])
        got_b = [t for i, (x, y) in enumerate(zip(bt[:-1], bt[1:], strict=True)) for t in pair.encode_b(text[x:y], i == 0)]
        assert got_a.tolist() == pair.encode_a(" " + text).tolist() and got_b == pair.encode_b(text, True)


def test_alignment_odd(spark, odd, none):
    got = crosstoken.align_tokens(odd, "doc_id", "text").collect()
    want = brute_alignment([r[1] for r in ODD])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((r[0], *w) for r, w in zip(ODD, want, strict=True)), key=repr)
    assert crosstoken.align_tokens(none, "doc_id", "text").collect() == []
