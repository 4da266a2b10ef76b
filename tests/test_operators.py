"""Operators against brute force: running sums, percentiles, nearest neighbours through growing cells, the chosen conformer."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from residua.operators import components, geometry, metrics, parity, position, ranking, reshape, sequence, stats, vectorindex
from residua.sources import files


def superpose(mobile, target):
    """The rigid motion of the rows of ``mobile`` that brings them closest to ``target``, by singular values."""
    cm, ct = mobile.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((mobile - cm).T @ (target - ct))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return (mobile - cm) @ (u @ flip @ vt) + ct


def test_superposition_of_any_points(spark):
    """Against singular values: mirrored, flat, straight, coinciding and far-away points; where several rotations are best, by the distance that is left."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(40):
        x, y = rng.normal(size=(9, 3)), rng.normal(size=(9, 3))
        kind = g % 8
        if kind == 1:
            y = x * [1, 1, -1]
        if kind == 2:
            x[:, 2] = 0
        if kind == 3:
            x = np.outer(rng.normal(size=9), [1.0, 2.0, 3.0])
        if kind == 4:
            x[:] = 1.5
        if kind == 5:
            x, y = x + 1e4, x + rng.normal(size=(9, 3)) * 0.01
        if kind == 6:
            y = x @ np.diag([-1.0, -1.0, 1.0])
        if kind == 7:
            x, y = x * 1e-3, y * 1e3
        want[g] = float(((superpose(x, y) - y) ** 2).sum())
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g long, a double, b double, c double, x double, y double, z double")
    for r in sequence.superposition(df, ["g"], ["a", "b", "c"], ["x", "y", "z"]).collect():
        turn = np.array(r["turn"]).reshape(3, 3)
        own = np.array([v[1:] for v in rows if v[0] == r["g"]])
        left = float((((own[:, :3] - r["centre"]) @ turn.T + r["goal"] - own[:, 3:]) ** 2).sum())
        assert np.abs(turn @ turn.T - np.eye(3)).max() < 1e-9 and np.linalg.det(turn) > 0
        assert abs(left - want[r["g"]]) <= 1e-7 * max(1.0, (own[:, 3:] ** 2).sum()), (r["g"], left, want[r["g"]])
    assert sequence.superposition(df.limit(0), ["g"], ["a", "b", "c"], ["x", "y", "z"]).collect() == []


def test_alignment_in_linear_space(monkeypatch):
    """However the rows are cut, the same alignment comes out; long strings stay within memory."""
    rng = random.Random(9)
    pairs = [("".join(rng.choice("ABCD") for _ in range(rng.randrange(60))), "".join(rng.choice("ABCD") for _ in range(rng.randrange(60)))) for _ in range(60)] + [("", ""), ("", "AB"), ("AB", ""), ("é日", "日")]
    whole = [sequence.align(a, b) for a, b in pairs]
    for cells in (1, 64, 700):
        monkeypatch.setattr(sequence, "CELLS", cells)
        assert [sequence.align(a, b) for a, b in pairs] == whole
    monkeypatch.undo()
    a = "".join(rng.choice("ACDEFGHIKL") for _ in range(6000))
    b = a[:2000] + a[2300:5000] + "W" * 80 + a[5000:]
    tracemalloc.start()
    score, x, y = sequence.align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score == 2.0 * (len(b) - 80) - (2 + 0.5 * 299) - (2 + 0.5 * 79) and x.replace("-", "") == a and y.replace("-", "") == b
    assert most < 20e6

def test_running_and_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.random()]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {r["i"]: (r["n"], r["s"]) for r in ranking.running(df, ["v", "i"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
    total = 0.0
    for k, (_, v, i) in enumerate(order):
        assert got[i][0] == k and abs(got[i][1] - total) < 1e-9
        total += v or 0.0
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    one = ranking.order_statistics(df, "v", at).first()
    known = [r[1] for r in rows if r[1] is not None]
    assert all(abs(one[k] - np.percentile(known, 100 * q)) < 1e-9 for k, q in at.items())
    for r in ranking.order_statistics(df.where("g is not null"), "v", at, by="g").collect():
        own = [x[1] for x in rows if x[0] == r["g"] and x[1] is not None]
        assert all(abs(r[k] - np.percentile(own, 100 * q)) < 1e-9 for k, q in at.items())
    assert ranking.order_statistics(df.limit(0), "v", at).first()["p50"] is None and ranking.running(df.limit(0), ["v"], {"n": F.lit(1)}).count() == 0
    none = metrics.metrics_overall(df.limit(0).withColumn("p", F.col("v")), "v", "p").first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0, 0)


def test_nearest_through_growing_cells(spark, monkeypatch):
    """Dense and sparse parts, an entity smaller than k, one without extent, ties."""
    rng = np.random.default_rng(8)
    rows = []
    for e, n in (("dense", 160), ("few", 4), ("flat", 30), ("twins", 60)):
        x = rng.normal(size=(n, 3)) * (0.1 if e == "dense" else 1.0)
        x[: n // 5] *= 30
        if e == "flat":
            x[:] = 1.0
        if e == "twins":
            x[1::2] = x[::2]
        rows += [(e, i, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame([*rows, ("few", None, 0.0, 0.0, 0.0), ("few", 9, None, 0.0, 0.0)], "e string, p long, x double, y double, z double")
    want = {}
    for e, i, *a in rows:
        far = sorted((float(np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)), j) for f, j, *b in rows if f == e and abs(i - j) >= 2)
        want |= {(e, i, s): j for s, (_, j) in enumerate(far[:3])}
    for limit, cell in ((10_000, None), (20, None), (20, 0.3)):
        monkeypatch.setattr(geometry, "WHOLE_ENTITY", limit)
        got = {(r["e"], r["pos"], r["slot"]): r["neighbour"] for r in geometry.spatial_knn(df, "e", "p", ["x", "y", "z"], k=3, min_sep=2, cell=cell).collect()}
        assert got == want
    assert geometry.spatial_knn(df.limit(0), "e", "p", ["x", "y", "z"]).count() == 0


def test_chosen_conformer(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for e in range(6):
        base = rng.normal(size=(14, 3))
        models = []
        for m in range(1, 5):
            q, r = np.linalg.qr(rng.normal(size=(3, 3)))
            q = q * np.sign(np.diag(r))
            q[:, 0] *= np.sign(np.linalg.det(q))
            models.append((base + rng.normal(size=base.shape) * 0.05 * rng.integers(1, 6)) @ q + rng.normal(size=3))
        laid = np.array([superpose(x, models[0]) for x in models])
        rmsd = np.sqrt(((laid - np.median(laid, axis=0)) ** 2).sum(axis=2).mean(axis=1))
        want[e] = (int(np.argmin(rmsd)) + 1, float(rmsd.min()))
        rows += [(e, m, p, *map(float, x[p])) for m, x in enumerate(models, 1) for p in range(14)]
    rows += [(9, m, p, 0.0, 1.0, float(p)) for m in (2, 3) for p in range(5)]
    df = spark.createDataFrame(rows, "e long, m int, p int, x double, y double, z double")
    got = {r["e"]: (r["m"], r["rmsd"]) for r in sequence.best_conformer(df, "e", "m", "p", ["x", "y", "z"]).collect()}
    assert got.pop(9) == (2, None) and set(got) == set(want)
    assert all(got[e][0] == m and abs(got[e][1] - d) < 1e-9 for e, (m, d) in want.items())


def test_near_duplicate_copies(spark):
    """Many equal sets are linked by their smallest key, one row each."""
    rows = [(i, "the same few words here") for i in range(40)] + [(100, "other words that stand alone"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r["a"], r["b"]) for r in sequence.near_duplicates(df, "id", F.filter(F.split("t", " "), lambda w: w != "")).collect()}
    assert got == {(0, i) for i in range(1, 40)}


def test_mapped_join_sides(spark):
    m = spark.createDataFrame([("e", 1, 1, "match"), ("e", 2, None, "gap_in_cs"), ("e", None, 3, "gap_in_structure"), ("e", 4, 9, "match")], "e string, struct_id int, target_id int, kind string")
    t = spark.createDataFrame([("e", 1, "ALA", 5.0), ("e", 3, "GLY", 6.0)], "e string, pos int, code string, shift double")
    s = spark.createDataFrame([("e", 1, "ALA"), ("e", 2, "XYZ"), ("e", 4, "SER")], "e string, pos int, code string")
    r = spark.createDataFrame([("e", 1, "H", 60.0)], "e string, pos int, ss string, phi double")
    n = spark.createDataFrame([("e", 1, 1, 7, 2.0), ("e", 1, 0, 4, 1.0)], "e string, pos int, slot int, neighbour int, dist double")
    rows = {r["pos"]: r for r in reshape.mapped_join(m, t, s, "e", known=["ALA", "SER"], report=r, neighbours=n).collect()}
    assert set(rows) == {1, 2, 3} and rows[2]["code"] == "UNK" and rows[3]["code"] == "GLY" and rows[1]["ss"] == "H" and rows[2]["ss"] is None
    assert [z["neighbour"] for z in rows[1]["spatial"]] == [4, 7] and rows[3]["spatial"] is None


def test_approximate_neighbours(spark):
    """What the index finds has exact scores; nearly all of the exact search is among it."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "id long, grp long, v array<double>")
    exact = {(r["id"], r["neighbour"]): r["score"] for r in geometry.knn_exclude_group(df, "id", "grp", "v", k=5).collect()}
    near = {(r["id"], r["neighbour"]): r["score"] for r in geometry.knn_exclude_group(df, "id", "grp", "v", k=5, approx=True).collect()}
    assert all(abs(s - float(x[i] @ x[j])) < 1e-5 and (i - j) % 2 for (i, j), s in near.items())
    assert len(set(near) & set(exact)) >= 0.95 * len(exact)


def test_vector_index(spark, monkeypatch):
    """Clustered vectors, several parts of a cell and blocks of queries, null rows, ties and repeated vectors."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in rng.normal(size=(20, 16))])
    x[-1] = x[0]
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (9000, 1, None), (None, 1, rows[0][2]), (9001, None, rows[1][2])], "id long, grp long, v array<double>").repartition(3)
    index = vectorindex.fit(df, "id", "grp", "v", k=5)
    assert index.recall >= 0.95 and index.probes < len(index.cells)
    for rows_a_part, queries, shard in ((65_536, 1_000_000, 8192), (16, 40, 8192), (65_536, 1_000_000, 1), (16, 40, 50)):
        monkeypatch.setattr(vectorindex, "SHARD", shard)
        monkeypatch.setattr(vectorindex, "ROWS", rows_a_part)
        monkeypatch.setattr(vectorindex, "QUERIES", queries)
        got = {(r["id"], r["rank"]): (r["neighbour"], r["score"]) for r in vectorindex.search(df, "id", "grp", "v", index, k=5, queries=F.col("id") % 20 == 0).where("id < 9000").collect()}
        hit = 0
        for i in range(0, len(x), 20):
            s = x @ x[i]
            best = sorted((j for j in range(len(x)) if (i - j) % 3), key=lambda j: (-round(s[j], 6), j))[:5]
            own = [got[i, r][0] for r in range(1, 6)]
            assert all(abs(got[i, r][1] - s[got[i, r][0]]) < 1e-5 for r in range(1, 6) if got[i, r][0] < 9000)
            hit += len({*best} & {*own})
        assert hit >= 0.95 * len(range(0, len(x), 20)) * 5
    empty = df.limit(0)
    assert vectorindex.search(empty, "id", "grp", "v", vectorindex.fit(empty, "id", "grp", "v")).collect() == []


def test_percentiles_by_bands(spark, monkeypatch):
    """Few rows in a band, so that sketches are taken again and again; ties, infinities and one value for all."""
    rng = np.random.default_rng(3)
    tables = {
        "normal": rng.normal(size=3000).tolist(), "ties": [float(v) for v in rng.integers(0, 5, 3000)], "one": [2.5] * 500, "two": [1.0, 2.0], "mixed": [float("inf")] * 40 + rng.exponential(size=900).tolist() + [float("-inf")] * 3,
        "skew": (rng.pareto(0.3, 2000) * 1e-3).tolist(), "half": [0.0] * 1500 + rng.random(1500).tolist(),
    }
    at = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    for band, accuracy in ((100_000, 10_000), (10, 50)):
        monkeypatch.setattr(ranking, "BAND", band)
        monkeypatch.setattr(ranking, "ACCURACY", accuracy)
        for name, values in tables.items():
            got = ranking.order_statistics(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", at).first()
            for k, q in at.items():
                own, place = sorted(values), (len(values) - 1) * q
                lo, hi = own[int(np.floor(place))], own[int(np.ceil(place))]
                want = lo if place == int(place) else (np.ceil(place) - place) * lo + (place - np.floor(place)) * hi
                assert got[k] == want or abs(got[k] - want) < 1e-12 * max(1.0, abs(want)), (name, k, got[k], want)


def test_train_only_statistics(spark):
    """Far from zero, where subtraction would lose all digits; empty and single folds, nulls."""
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, 2, 3, 6, None]), rng.choice("ab"), rng.choice([None, 1e9 + rng.random()])) for _ in range(400)] + [(1, "c", 5.0), (2, "d", None)]
    df = spark.createDataFrame(rows, "fold int, col string, v double")
    got = {(r["held_out"], r["col"]): r for r in stats.train_only_stats(df, "col", "v", "fold", [1, 2, 3]).collect()}
    want = {}
    for k in (1, 2, 3):
        for c in "abcd":
            own = [v for f, x, v in rows if x == c and f in (1, 2, 3) and f != k]
            if own:
                seen = [v for v in own if v is not None]
                std = float(np.std(seen, ddof=1)) if len(seen) > 1 else 0.1
                want[k, c] = (len(seen), float(np.mean(seen)) if seen else 0.0, max(std, 0.1) if seen else 1.0)
    assert set(got) == set(want)
    for key, (n, mean, std) in want.items():
        assert got[key]["n"] == n and abs(got[key]["mean"] - mean) < 1e-6 and abs(got[key]["std"] - std) < 1e-6


def test_components_of_forests(spark, monkeypatch):
    """Chains, stars, cliques and numbers as text, in one task and dealt to many."""
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    edges += [(None, 5), (7, None), (9, 9), (2001, 2000)]
    for cast in (int, str):
        root = {}
        own = [tuple(None if x is None else cast(x) for x in e) for e in edges]
        for a, b in own:
            if a is not None and b is not None and a != b:
                root.setdefault(a, a)
                root.setdefault(b, b)
        moved = True
        while moved:
            moved = False
            for a, b in own:
                if a in root and b in root and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
        df = spark.createDataFrame(own, f"src {'long' if cast is int else 'string'}, dst {'long' if cast is int else 'string'}")
        for limit in (1_000_000, 50):
            monkeypatch.setattr(components, "EDGES", limit)
            assert {r["id"]: r["component"] for r in components.connected_components(df).collect()} == root
    assert components.connected_components(df.limit(0)).collect() == []


def test_parity_by_digests(spark):
    rows = [(i, float(i % 7), [float(i), None], None if i % 3 else "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v double, a array<double>, s string")
    told = lambda x, y: [tuple(r) for r in parity.differences(x, y, ["k"], ("x", "y")).orderBy("side").collect()]
    assert told(df, df.orderBy(F.desc("v"))) == [("x", 0, 500), ("y", 0, 500)]
    twice = df.unionByName(df.where("k = 3")).unionByName(df.where("k = 3"))
    changed = df.withColumn("v", F.when(F.col("k") == 8, 99.0).otherwise(F.col("v"))).where("k <> 9")
    assert told(twice, changed) == [("x", 4, 502), ("y", 1, 499)]
    assert told(df, df.limit(0)) == [("x", 500, 500), ("y", 0, 0)] and told(df.limit(0), df.limit(0)) == [("x", 0, 0), ("y", 0, 0)]


def test_one_long_entity_in_stretches(spark, monkeypatch):
    """Windows, neighbours and edges of an entity that is cut into many stretches are those of its plain order, and its rows stand in many tasks."""
    rng = random.Random(6)
    rows = [("hot", p, float(p % 97)) for p in sorted(rng.sample(range(-3000, 9000), 4000))] + [("far", p, 1.0) for p in (-900, 5, 6, 7, 100_000, 10**9)] + [("one", 3, 2.0), (None, 1, 0.5), (None, 2, 0.25)]
    df = spark.createDataFrame(rows, "e string, p long, v double").repartition(5)
    beside = lambda before, after: {"b": before("v"), "bp": before("p"), "a": after("v"), "ap": after("p")}
    for stretch in (1 << 16, 16, 3):
        monkeypatch.setattr(position, "STRETCH", stretch)
        context = position.window_context(df, "e", "p", ["v"], 5)
        got = {(r["e"], r["p"]): [tuple(z) for z in r["context"]] for r in context.collect()}
        rowwise = {(r["e"], r["p"]): r for r in position.adjacent(df, "e", "p", beside, "row").collect()}
        close = {(r["e"], r["p"]): r for r in position.adjacent(df, "e", "p", beside).collect()}
        edges = {(r["e"], r["p"]): r["is_edge"] for r in position.edge_flag(df, "e", "p").collect()}
        assert len(got) == len(rowwise) == len(close) == len(edges) == len(rows)
        for e in ("hot", "far", "one", None):
            own = [(p, v) for x, p, v in rows if x == e]
            for i, (p, _) in enumerate(own):
                assert got[e, p] == [(q - p, u) for q, u in own[max(0, i - 11) : i + 12] if abs(q - p) <= 5]
                last, first = (own[i - 1] if i else (None, None)), (own[i + 1] if i + 1 < len(own) else (None, None))
                assert (rowwise[e, p]["bp"], rowwise[e, p]["b"], rowwise[e, p]["ap"], rowwise[e, p]["a"]) == (*last, *first)
                assert (close[e, p]["b"], close[e, p]["a"]) == (last[1] if last[0] == p - 1 else None, first[1] if first[0] == p + 1 else None)
                assert edges[e, p] == (i < 2 or i >= len(own) - 2)
        if stretch == 16:
            held = [r["n"] for r in context.where("e = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert len(held) > 1 and max(held) < 0.6 * sum(held)
    assert position.edge_flag(df.limit(0), "e", "p").collect() == [] and position.adjacent(df.limit(0), "e", "p", beside, "row").collect() == []


def test_store_in_order(spark, tmp_path, monkeypatch):
    """A range of positions is in few row groups of few files, by their footers alone; the rows are those of a plain filter."""
    monkeypatch.setattr(files, "ROW_GROUP", 1 << 14)
    rows = [(f"e{i % 7}", i, i % 3, float(i) / 7) for i in range(60_000)]
    df = spark.createDataFrame(rows, "entity string, pos long, fold int, v double").repartition(6, "v")
    none = df.limit(0).select(F.lit("global").alias("scope"))
    for name, order in (("plain", None), ("sorted", ["entity", "pos"])):
        files.write_feature_store(df, none, f"file://{tmp_path}/{name}", order=order)
        got = files.read_range(spark, f"file://{tmp_path}/{name}", 1, "entity", "e3", "pos", 20_000, 21_000)
        assert {tuple(r) for r in got.select("entity", "pos", "fold", "v").collect()} == {r for r in rows if r[0] == "e3" and r[2] == 1 and 20_000 <= r[1] <= 21_000}
    parts = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "sorted" / "features" / "fold=1").glob("*.parquet"))]
    groups = [m.row_group(i) for m in parts for i in range(m.num_row_groups)]
    by = {parts[0].row_group(0).column(c).path_in_schema: c for c in range(parts[0].num_columns)}
    held = [g.num_rows for g in groups if g.column(by["entity"]).statistics.min <= "e3" <= g.column(by["entity"]).statistics.max and g.column(by["pos"]).statistics.min <= 21_000 and g.column(by["pos"]).statistics.max >= 20_000]
    assert sum(held) < 0.7 * sum(g.num_rows for g in groups) and len(groups) > 1


def test_error_histogram_edges(spark, tmp_path):
    """Errors that stand on a bin's edge by decimal arithmetic, though not by the sum of doubles: all in the bin above it."""
    from collections import Counter

    from residua.plans import catalogue

    cents = [(u, 7 * u + 1 + 400 * (1 + u % 3) * j) for u in range(300) for j in range(7)]
    rows = [(i, u, "view", v / 100) for i, (u, v) in enumerate(cents)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = Counter((7 * u + 1 + 1200 * (1 + u % 3) - v + 10_000) // 400 for u, v in cents)
    got = {r["bin"]: r["n"] for r in catalogue.queries()["error_histogram"](spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_feature_parity_takes_statistics_once(spark, small, monkeypatch):
    """Statistics whose last bits differ each time that they are computed, as those of large tables do."""
    from residua.plans import catalogue, features

    once = features.train_stats
    monkeypatch.setattr(features, "train_stats", lambda rows: once(rows).withColumn("mean", F.col("mean") + F.rand() * 1e-9))
    assert [r["n_missing"] for r in catalogue.queries()["feature_parity"](spark, small).collect()] == [0, 0]


def test_knn_cells_follow_density(spark):
    """A dense middle in a wide extent: the first cells hold few of its points, and the rows are those of brute force."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.01, (2400, 3)), rng.uniform(-50, 50, (100, 3))])
    df = spark.createDataFrame([("e", i, *map(float, p)) for i, p in enumerate(x)], "e string, p long, x double, y double, z double")
    a = df.select("e", F.col("p").alias("pos"), F.col("x").alias("a0"), F.col("y").alias("a1"), F.col("z").alias("a2"))
    side = geometry._first_sides(a, "e", spark.createDataFrame([("e", float(np.ptp(x, axis=0).max()))], "e string, most double")).first()["side"]
    assert side < 0.03
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    i = np.arange(len(x))
    d[np.abs(i[:, None] - i[None]) < 4] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = {(r["pos"], r["slot"]): r["neighbour"] for r in geometry.spatial_knn(df, "e", "p", ["x", "y", "z"]).collect()}
    assert got == {(int(p), s): int(want[p, s]) for p in i for s in range(5)}


def test_cross_pairs_brute_force(spark):
    """Pairs in the order (d, code, a1, a2), many of them at the same distance, cut at the cap; atoms in any order, some without a coordinate."""
    rng = random.Random(6)
    names = ["N", "CA", "C", "H", "HA", "1HG1"]
    atoms = {p: [(n, *[float(rng.randint(0, 2)) if rng.random() > 0.05 else None for _ in "xyz"]) for n in rng.sample(names, rng.randint(0, 6))] for p in range(30)}
    rows = spark.createDataFrame([("e", p, v) for p, v in atoms.items()], "e string, p long, atoms array<struct<atom:string,x:double,y:double,z:double>>")
    near = {(p, s): rng.randrange(30) for p in range(30) for s in range(2)}
    neighbours = spark.createDataFrame([("e", p, s, n) for (p, s), n in near.items()], "e string, p long, slot int, neighbour long")
    got = {r["p"]: [tuple(z) for z in r["pairs"]] for r in geometry.cross_pairs(rows, neighbours, "e", "p", w=2, cap=15, heavy=2.0, h=1.5).collect()}
    is_h = lambda n: n.startswith("H") or n[:2] == "1H"
    for p, own in atoms.items():
        met = [(p + s, s + 3) for s in (-2, -1, 1, 2)] + [(near[p, s], 6 + s) for s in range(2) if abs(near[p, s] - p) > 2]
        pairs = []
        for q, code in met:
            for a in own:
                for b in atoms.get(q, []):
                    if None in (*a, *b) or is_h(a[0]) and is_h(b[0]):
                        continue
                    d = sum((u - v) ** 2 for u, v in zip(a[1:], b[1:], strict=True)) ** 0.5
                    if d <= (1.5 if is_h(a[0]) or is_h(b[0]) else 2.0):
                        pairs.append((d, code, a[0], b[0]))
        assert got.get(p, []) == sorted(pairs)[:15]


def test_near_duplicates_any_order(spark, monkeypatch):
    """Long and short texts with frequent passages, at several thresholds: the pairs are those of brute force whatever is counted as frequent."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(24):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 90, 400]))] + (passage if i % 2 else [])
        for _ in range(3):
            texts.append([w if rng.random() > 0.01 else "x" for w in own][: len(own) - rng.randint(0, len(own) // 12)])
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} or {tuple(t)} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w array<string>")
    for threshold, frequent in ((0.9, 200_000), (0.9, 10), (0.6, 10)):
        monkeypatch.setattr(sequence, "FREQUENT", frequent)
        got = {(r["a"], r["b"]): r["common"] for r in sequence.near_duplicates(df, "id", F.col("w"), threshold=threshold, coverage=0.0).collect()}
        want = {(a, b): len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        low = {ab: n for ab, n in want.items() if sets[ab[0]] != sets[ab[1]]}
        # equal sets are linked by their smallest key, and only that one meets others
        rep = {i: next(j for j, s in enumerate(sets) if s == sets[i]) for i in range(len(sets))}
        assert got == {(a, b): n for (a, b), n in low.items() if rep[a] == a and rep[b] == b} | {(rep[i], i): len(sets[i]) for i in rep if rep[i] != i}


def test_near_duplicates_send_few_shingles(spark, monkeypatch):
    """Of texts that resemble none, an eighth of the shingles at most is sent on."""
    rng = random.Random(9)
    df = spark.createDataFrame([(i, [f"w{rng.randrange(10**6)}" for _ in range(300)]) for i in range(200)], "id long, w array<string>")
    kept, once = {}, sequence.written
    monkeypatch.setattr(sequence, "written", lambda table, name: kept.setdefault(name, once(table, name)))
    assert sequence.near_duplicates(df, "id", F.col("w")).count() == 0
    assert kept["firsts"].agg(F.sum(F.size("first"))).first()[0] <= 200 * 298 / 8


def test_knn_queries_alone(spark):
    """Only the rows that are asked for are sent as queries; ties, large groups and a null group come out as by brute force."""
    from residua.operators import blocks

    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (3000, 4)).astype(float)
    groups = [None if i % 9 == 0 else "a" if i % 3 else "b" for i in range(3000)]
    df = spark.createDataFrame([(i, groups[i], list(map(float, v))) for i, v in enumerate(x)], "id long, g string, v array<double>")
    got = {}
    for r in geometry.knn_exclude_group(df, "id", "g", "v", 7, queries=F.col("id") % 20 == 0).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["score"])
    scores = x @ x.T
    for q in range(0, 3000, 20):
        best = sorted((-scores[q, j], j) for j in range(3000) if groups[j] != groups[q])[:7]
        assert got.pop(q) == {n + 1: (j, -s) for n, (s, j) in enumerate(best)}
    assert not got
    best = blocks._Best(np.arange(600), np.zeros(600, np.int64), x[:600], 7)
    best.meet(np.arange(3000), np.ones(3000, np.int64), x)
    assert best.n_waiting < 600 * 3000 / 2
