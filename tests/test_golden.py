"""Rows worked by hand, brute force on small inputs, invariants and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions import expressions as X
from residua.operators import geometry, metrics, quality, sequence, split, stats
from residua.operators.components import connected_components


def test_hash_folds(spark):
    keys = ["4769", "15000", "bmrb_4769", "bmrb_15000", "comp_10002", "comp_4769"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", X.md5_fold(F.col("k"), 5)).collect()}
    assert [got[k] for k in keys] == [5, 2, 3, 1, 2, 5]


def test_components_and_folds(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("f", "f"), (None, "a")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    comps = connected_components(edges, nodes)
    assert {r[0]: r[1] for r in comps.collect()} == dict(zip("abcdef", "aaaddf", strict=True))
    seeds = spark.createDataFrame([("b",)], "id string")
    excluded = split.exclusion_propagation(comps, seeds)
    folds = split.assign_folds(comps, excluded)
    got = {r["id"]: r["fold"] for r in folds.collect()}
    assert got["a"] == got["b"] == got["c"] == 0 and got["d"] == got["e"] > 0
    held = split.holdout_force(folds, spark.createDataFrame([("e",), ("z",)], "id string"))
    after = {r["id"]: r["fold"] for r in held.collect()}
    assert after["d"] == after["e"] == after["z"] == 6 and after["a"] == 0
    report = split.leakage_report(folds, nodes.withColumn("grp", F.col("id")), excluded)
    split.require_no_leak(report)
    assert connected_components(edges.limit(0)).count() == 0


def test_components_random(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_distances(spark):
    atoms = spark.createDataFrame([(1, "CA", 0.0, 0.0, 0.0), (1, "CB", 3.0, 4.0, 0.0), (1, "H", 0.0, 0.0, 1.0), (1, "HA", 9.0, 9.0, 9.0), (1, "CG", float("nan"), 0.0, 0.0)], "k int, atom string, x double, y double, z double")
    got = {(r["a1"], r["a2"]): r["d"] for r in geometry.intra_pairs(geometry.atom_arrays(atoms, ["k"]), ["k"]).collect()}
    assert got[("CA", "CB")] == 5 and got[("CA", "H")] == 1 and math.isclose(got[("CB", "H")], math.sqrt(26)) and ("H", "HA") not in got
    names = spark.createDataFrame([("DD1",), ("1HG1",), ("HB",), (None,), ("",)], "a string")
    assert [r[0] for r in names.select(X.is_hydrogen(F.col("a"))).collect()] == [False, True, True, False, False]
    cloud = spark.createDataFrame([(1, "CA", 0.0, 0.0, 0.0), (1, "CB", 1.0, 0.0, 0.0), (1, "CG", 3.0, 0.0, 0.0), (2, "CB", 1.0, 0.0, 0.0), (3, "CA", 0.0, 0.0, 0.0)], "k int, atom string, x double, y double, z double")
    rows = {r["k"]: r for r in geometry.cloud_summary(geometry.atom_arrays(cloud, ["k"]), ["k"]).collect()}
    assert tuple(rows[1])[1:] == (2, 2.0, 1.0, 3.0, 2.0) and 2 not in rows and rows[3]["n"] == 0 and rows[3]["mean"] is None


@pytest.mark.parametrize("cell", [None, 3.0])
def test_neighbours_on_a_line(spark, cell):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(1, 11)], "e int, p int, x double, y double, z double")
    rows = geometry.spatial_knn(df, "e", "p", ["x", "y", "z"], cell=cell).orderBy("pos", "slot").collect()
    assert [r["neighbour"] for r in rows if r["pos"] == 1] == [5, 6, 7, 8, 9]
    assert [r["neighbour"] for r in rows if r["pos"] == 5] == [1, 9, 10]


def test_outlier_rules(spark):
    rows = [("a", float(i % 2)) for i in range(8)] + [("a", 99.0)] + [("b", 1.0)] * 20 + [("c", float(i % 2)) for i in range(400)] + [("c", 500.0), ("d", None)]
    out, counts = quality.null_group_outliers(spark.createDataFrame(rows, "g string, v double"), ["v"], "g")
    assert counts.first()["v"] == 1 and out.where("g = 'c' and v is null").count() == 1 and out.count() == len(rows)
    empty, none = quality.null_group_outliers(spark.createDataFrame([], "g string, v double"), ["v"], "g")
    assert empty.count() == 0 and none.first()["v"] == 0


def test_huber_and_swap(spark):
    one = spark.createDataFrame([(0.0, 0.2), (0.0, 1.0)], "y double, p double")
    assert math.isclose(metrics.huber(one, "y", "p", F.lit(1.0)).first()["loss"], (0.02 + 0.375) / 2)
    groups = spark.createDataFrame([("A", "g"), ("B", "g"), ("C", "g")], "k string, grp string")
    pairs = spark.createDataFrame([("X", "Y")], "k string, other string")
    swap = spark.createDataFrame([(1, "X", 2.0, 1.0), (1, "Y", 1.0, 2.0)], "r int, k string, y double, p double")
    assert metrics.swap_huber(swap, ["r"], "k", "y", "p", groups, pairs).first()["loss"] == 0
    lone = spark.createDataFrame([(1, "X", 2.0, 1.0), (1, "Y", None, 2.0)], "r int, k string, y double, p double")
    assert math.isclose(metrics.swap_huber(lone, ["r"], "k", "y", "p", groups, pairs).first()["loss"], 0.375)
    three = spark.createDataFrame([(1, k, 0.0, 1.0) for k in "ABC"], "r int, k string, y double, p double")
    assert math.isclose(metrics.swap_huber(three, ["r"], "k", "y", "p", groups, pairs).first()["loss"], 0.125)


def test_percentiles_and_constant_truth(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 4.0)], "y double, p double")
    r = metrics.metrics_overall(df, "y", "p").first()
    assert r["median"] == 2 and math.isclose(r["p95"], 3.8)
    assert metrics.metrics(df.withColumn("g", F.lit(1)), "y", "p", ["g"]).first()["r2"] == 0
    assert metrics.metrics_overall(df.limit(0), "y", "p").first()["mae"] == 0


def test_transfer(spark):
    base = X.random_coil(spark)
    df = spark.createDataFrame([("A", "G", "CA", 53.5), ("A", "P", "H", 8.30)], "s string, t string, atom string, v double")
    got = [r["corrected"] for r in stats.transfer_correct(df, base, "s", "t", "atom", "v").orderBy("atom").collect()]
    assert math.isclose(got[0], 46.1) and got[1] == 8.30


def test_normalise_round_trip(spark):
    df = spark.createDataFrame([("a", "x", float(i)) for i in range(30)] + [("b", "x", 5.0), ("b", "y", None)], "g string, c string, v double")
    st = stats.norm_stats(df, "c", "v", "g")
    back = stats.denormalise(stats.normalise(df, st, "c", "g", "v"), st, "c", "g", "z", "back")
    assert back.where("abs(back - v) > 1e-9").count() == 0
    assert st.where("scope = 'global' and col = 'y' and mean = 0 and std = 1 and n = 0").count() == 1


def score(a, b):
    """The best score over all alignments, by recursion on the last column."""
    from functools import cache

    @cache
    def f(i, j, s):
        if i == 0 and j == 0:
            return 0.0 if s == "m" else -math.inf
        best = -math.inf
        if s == "m" and i and j:
            best = max(f(i - 1, j - 1, x) for x in "mdr") + (2 if a[i - 1] == b[j - 1] else -1)
        if s == "d" and i:
            best = max(f(i - 1, j, x) + (-0.5 if x == "d" else -2) for x in "mdr")
        if s == "r" and j:
            best = max(f(i, j - 1, x) + (-0.5 if x == "r" else -2) for x in "mdr")
        return best

    return max(f(len(a), len(b), s) for s in "mdr")


def test_alignment_scores():
    assert sequence.align("ACD", "AD")[0] == 2 and sequence.align("ACCD", "AD")[0] == 1.5 and sequence.align("ACDEF", "ACDEF")[0] == 10
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randrange(8))) for _ in range(2))
        got, x, y = sequence.align(a, b)
        assert math.isclose(got, score(a, b)), (a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        again = sum((2 if p == q else -1) for p, q in zip(x, y, strict=True) if "-" not in (p, q))
        for s in (x, y):
            again += sum(-2 - 0.5 * (len(list(g)) - 1) for k, g in itertools.groupby(s) if k == "-")
        assert math.isclose(again, got), (a, b, x, y)


def test_mapping(spark):
    df = spark.createDataFrame([(1, "ACDEFGHIKL", "ACDEFGHIKL"), (2, "ACDEFG-IKL", "ACDQFGHIKL")], "k int, a string, b string")
    rows = sequence.alignment_mapping(df, "k", "a", "b").orderBy("k", "col").collect()
    assert [r["kind"] for r in rows if r["k"] == 1] == ["protein_edge"] * 2 + ["match"] * 6 + ["protein_edge"] * 2
    two = [r for r in rows if r["k"] == 2]
    assert two[3]["kind"] == "mismatch" and two[6]["kind"] == "gap_in_structure" and two[6]["index_a"] is None and two[6]["index_b"] == 6


def test_superposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    both = [(0, *map(float, a), *map(float, b)) for a, b in zip(x @ q + 3, x, strict=True)]
    turn = sequence.superposition(spark.createDataFrame(both, "g int, a double, b double, c double, x double, y double, z double"), ["g"], ["a", "b", "c"], ["x", "y", "z"]).first()
    moved = (x @ q + 3 - turn["centre"]) @ np.array(turn["turn"]).reshape(3, 3).T + turn["goal"]
    assert np.abs(moved - x).max() < 1e-9
    models = {1: x, 2: x @ q + 1, 3: x + rng.normal(scale=0.3, size=x.shape)}
    rows = [("e", m, i, *map(float, p)) for m, c in models.items() for i, p in enumerate(c)] + [("short", m, i, 0.0, 0.0, float(i)) for m in (4, 5) for i in range(3)]
    got = {r[0]: r for r in sequence.best_conformer(spark.createDataFrame(rows, "e string, m int, p int, x double, y double, z double"), "e", "m", "p", ["x", "y", "z"]).collect()}
    assert got["e"]["m"] in (1, 2) and got["short"]["m"] == 4 and got["short"]["rmsd"] is None


def test_near_duplicates_brute_force(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 14))] for _ in range(60)]
    docs += [d[:] for d in docs[:10]] + [d[:-1] for d in docs[10:30]]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, w array<string>")

    def grams(w):
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    sets = [grams(w) for w in docs]
    for mode in ("both", "containment"):
        got = {(r["a"], r["b"]) for r in sequence.near_duplicates(df, "id", F.col("w"), threshold=0.8, coverage=0.0, mode=mode).collect()}
        reps = {}
        for i, s in enumerate(sets):
            reps.setdefault(frozenset(s), i)
        want = {(reps[frozenset(s)], i) for i, s in enumerate(sets) if s and reps[frozenset(s)] != i}
        own = sorted(i for s, i in reps.items() if s)
        for a, b in itertools.combinations(own, 2):
            both, low = len(sets[a] & sets[b]), len(sets[a] | sets[b]) if mode == "both" else min(len(sets[a]), len(sets[b]))
            if both >= 0.8 * low:
                want.add((a, b))
        assert got == want


def test_gates(spark):
    df = spark.createDataFrame([(1, "stamped"), (2, None)], "id int, provenance string")
    with pytest.raises(ValueError):
        quality.require_stamped(df)
    with pytest.raises(ValueError):
        quality.require_stamped(df.limit(0))
    assert quality.require_stamped(df.where("id = 1")).count() == 1
    gates = [quality.gate(x, str(i), F.col("provenance") != "stamped", 1) for i, x in enumerate((df, df.limit(0), df.where("id = 1")))]
    assert [r["passed"] for r in gates[0].unionByName(gates[1]).unionByName(gates[2]).orderBy("gate").collect()] == [False, False, True]
    quality.require_gates(gates[2])
    with pytest.raises(ValueError, match="not passed: 0"):
        quality.require_gates(gates[0])
    with pytest.raises(ValueError):
        X.ablate(df, {"a": ["id"]}, ["b"])
