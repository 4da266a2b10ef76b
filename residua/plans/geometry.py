"""Points and atoms from the embeddings: entity = label, position = vec_id, coordinates = triples of the vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.expressions import md5_fold
from residua.operators import geometry, position, scoring, sequence, vectorindex
from residua.operators import split as splits
from residua.plans.measures import fold_sql, r6
from residua.plans.registry import Tables, query
from residua.scratch import written

#: Names for the 21 triples of a vector.
NAMES = "N CA C O CB CG CD H HA HB2 HB3 HG2 HG3 HD1 HD2 NE CZ OG SD OH 1HG1".split()
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
ATOMS = f"""atoms AS (SELECT label, vec_id, ({NAMES_SQL})[i] AS atom, CAST(embedding[3 * i - 2] AS DOUBLE) AS x, CAST(embedding[3 * i - 1] AS DOUBLE) AS y, CAST(embedding[3 * i] AS DOUBLE) AS z FROM embeddings, range(1, 22) r(i)),
atom AS (SELECT *, regexp_matches(atom, '^(H|[0-9]H)') AS h FROM atoms)"""
DIST = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"
POINTS = "pts AS (SELECT label, vec_id AS pos, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
KNN = f"""{POINTS}, knn AS (SELECT label, pos, slot, neighbour, dist FROM (SELECT a.label, a.pos, b.pos AS neighbour, {DIST.format(a='a', b='b')} AS dist,
  CAST(row_number() OVER (PARTITION BY a.label, a.pos ORDER BY {DIST.format(a='a', b='b')}, b.pos) - 1 AS INTEGER) AS slot FROM pts a JOIN pts b ON a.label = b.label AND abs(a.pos - b.pos) >= 4) WHERE slot < 5)"""


def points(t: Tables) -> DataFrame:
    return t.embeddings.select("label", F.col("vec_id").alias("pos"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def residues(t: Tables) -> DataFrame:
    """Atom arrays straight from the vectors, sorted by name; no shuffle."""
    e = lambda i: F.col("embedding")[i].cast("double")
    atoms = F.array_sort(F.array(*[F.struct(F.lit(n).alias("atom"), e(3 * i).alias("x"), e(3 * i + 1).alias("y"), e(3 * i + 2).alias("z")) for i, n in enumerate(NAMES)]))
    return t.embeddings.select("label", F.col("vec_id").alias("pos"), atoms.alias("atoms"))


def knn(t: Tables) -> DataFrame:
    return geometry.spatial_knn(points(t), "label", "pos", ["x", "y", "z"])


@query(f"WITH {KNN} SELECT label, pos, slot, neighbour, round(dist, 6) AS dist, neighbour - pos AS seq_sep FROM knn")
def spatial_knn(t: Tables) -> DataFrame:
    return r6(knn(t), "dist")


@query(f"WITH {KNN} SELECT label, pos, slot, neighbour, round(dist, 6) AS dist, neighbour - pos AS seq_sep FROM knn")
def spatial_knn_grid(t: Tables) -> DataFrame:
    return r6(geometry.spatial_knn(points(t), "label", "pos", ["x", "y", "z"], cell=0.1), "dist")


@query(f"WITH {KNN} SELECT k.label, k.pos, k.slot, k.neighbour, round(p.x, 6) AS x, p.pos IS NOT NULL AS valid FROM knn k LEFT JOIN pts p ON p.label = k.label AND p.pos = k.neighbour AND p.pos % 7 <> 0".replace("p.pos IS NOT NULL", "p.x IS NOT NULL"))
def neighbour_gather(t: Tables) -> DataFrame:
    src = points(t).where("pos % 7 <> 0")
    return r6(position.neighbour_gather(src, knn(t).select("label", "pos", "slot", "neighbour"), "label", "pos", ["x"]).select("label", "pos", "slot", "neighbour", "x", "valid"), "x")


@query(f"WITH {ATOMS} SELECT a.label, a.vec_id AS pos, count(*) AS n, round(min({DIST.format(a='a', b='b')}), 6) AS least, round(avg({DIST.format(a='a', b='b')}), 6) AS mean FROM atom a JOIN atom b ON a.vec_id = b.vec_id AND a.atom < b.atom AND NOT (a.h AND b.h) GROUP BY 1, 2")
def intra_pairs(t: Tables) -> DataFrame:
    p = geometry.intra_pairs(residues(t), ["label", "pos"])
    return r6(p.groupBy("label", "pos").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.avg("d").alias("mean")), "least", "mean")


@query(
    f"""WITH {ATOMS}, p AS (SELECT a.vec_id AS pos, a.atom AS a1, b.atom AS a2, greatest(-5.0, least(10.0, {DIST.format(a='a', b='b')} / 10.0)) AS d FROM atom a JOIN atom b ON a.vec_id = b.vec_id AND a.atom < b.atom AND NOT (a.h AND b.h)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pos ORDER BY a1, a2) - 1 AS INTEGER) AS i FROM p) SELECT pos, i, a1, a2, round(d, 6) AS d FROM r WHERE i < 20"""
)
def sparse_topm(t: Tables) -> DataFrame:
    s = geometry.sparse_topm(geometry.intra_pairs(residues(t), ["pos"]), ["pos"], m=20)
    return r6(s.select("pos", F.posexplode("pairs").alias("i", "p")).select("pos", "i", "p.a1", "p.a2", "p.d"), "d")


@query(
    f"""WITH {ATOMS}, o AS (SELECT a.vec_id AS pos, {DIST.format(a='a', b='c')} AS d, a.x, a.y, a.z, c.x AS cx, c.y AS cy, c.z AS cz FROM atom a JOIN atom c ON a.vec_id = c.vec_id AND c.atom = 'CA' WHERE a.atom NOT IN ('N', 'CA', 'C', 'O', 'H', 'HA'))
SELECT pos, CAST(count(*) AS INTEGER) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS spread, round(max(d), 6) AS most, round(sqrt(pow(avg(x) - any_value(cx), 2) + pow(avg(y) - any_value(cy), 2) + pow(avg(z) - any_value(cz), 2)), 6) AS centroid FROM o GROUP BY 1"""
)
def cloud_summary(t: Tables) -> DataFrame:
    return r6(geometry.cloud_summary(residues(t), ["pos"]), "mean", "spread", "most", "centroid")


@query(
    f"""WITH {ATOMS}, {KNN}, part AS (SELECT a.label, a.pos, b.pos AS partner, CAST(b.pos - a.pos + 6 AS INTEGER) AS code FROM pts a JOIN pts b ON a.label = b.label AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5
  UNION ALL SELECT label, pos, neighbour, slot + 12 FROM knn WHERE abs(neighbour - pos) > 5),
pairs AS (SELECT p.label, p.pos, p.code, a.atom AS a1, b.atom AS a2, {DIST.format(a='a', b='b')} AS d, a.h OR b.h AS h FROM part p JOIN atom a ON a.vec_id = p.pos JOIN atom b ON b.vec_id = p.partner WHERE NOT (a.h AND b.h)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label, pos ORDER BY d, code, a1, a2) - 1 AS INTEGER) AS i FROM pairs WHERE d <= CASE WHEN h THEN 0.25 ELSE 0.35 END)
SELECT label, pos, i, round(d, 6) AS d, code, a1, a2 FROM r WHERE i < 20"""
)
def cross_pairs(t: Tables) -> DataFrame:
    c = geometry.cross_pairs(residues(t), knn(t), "label", "pos", cap=20, heavy=0.35, h=0.25)
    return r6(c.select("label", "pos", F.posexplode("pairs").alias("i", "p")).select("label", "pos", "i", "p.d", "p.code", "p.a1", "p.a2"), "d")


@query("WITH c AS (SELECT a.conv_id, a.turn, count(*) AS n_context, CAST(min(b.turn - a.turn) AS INTEGER) AS first_offset, string_agg(substr(b.role, 1, 1), '' ORDER BY b.turn) AS roles FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 GROUP BY 1, 2) SELECT * FROM c")
def window_context(t: Tables) -> DataFrame:
    c = position.window_context(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", ["role"], w=2)
    return c.select("conv_id", "turn", F.size("context").cast("long").alias("n_context"), F.array_min(F.transform("context", lambda z: z["offset"])).alias("first_offset"), F.array_join(F.transform("context", lambda z: F.substring(z["role"], 1, 1)), "").alias("roles"))


BONDS = f"""g AS (SELECT label, vec_id AS pos, {', '.join(f'CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS {a}{c}' for k, a in enumerate(('ca', 'c', 'n')) for i, c in enumerate('xyz'))} FROM embeddings),
l AS (SELECT *, {', '.join(f'lag({a}{c}) OVER w AS p{a}{c}, lead({a}{c}) OVER w AS f{a}{c}' for a in ('ca', 'c', 'n') for c in 'xyz')}, lag(pos) OVER w AS pp, lead(pos) OVER w AS fp FROM g WINDOW w AS (PARTITION BY label ORDER BY pos))"""


def _bond(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz") + ")"


def _bond_sql(mode: str) -> str:
    back, forth = ("pp = pos - 1", "fp = pos + 1") if mode == "true" else ("true", "true")
    parts = [("bond_ca_prev", "ca", "pca", back), ("bond_ca_next", "ca", "fca", forth), ("bond_peptide_fwd", "c", "fn", forth), ("bond_peptide_bkwd", "pc", "n", back)]
    return f"WITH {BONDS} SELECT pos, " + ", ".join(f"CASE WHEN {ok} THEN round({_bond(a, b)}, 6) END AS {name}" for name, a, b, ok in parts) + " FROM l"


def _bonds(t: Tables, mode: str) -> DataFrame:
    e = t.embeddings.select("label", F.col("vec_id").alias("pos"), *[F.col("embedding")[3 * k + i].cast("double").alias(f"{a}_{c}") for k, a in enumerate(("ca", "c", "n")) for i, c in enumerate("xyz")])
    out = position.adjacent_geometry(e, "label", "pos", mode)
    names = ["bond_ca_prev", "bond_ca_next", "bond_peptide_fwd", "bond_peptide_bkwd"]
    return r6(out.select("pos", *names), *names)


@query(_bond_sql("true"))
def adjacent_geometry(t: Tables) -> DataFrame:
    return _bonds(t, "true")


@query(_bond_sql("row"))
def adjacent_geometry_rows(t: Tables) -> DataFrame:
    return _bonds(t, "row")


@query("SELECT vec_id AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2 OR row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 2 AS is_edge FROM embeddings")
def edge_flag(t: Tables) -> DataFrame:
    return position.edge_flag(points(t).select("label", "pos"), "label", "pos").select("pos", "is_edge")


@query('SELECT label, min(vec_id) AS "first", max(vec_id) AS "last", count(*) AS n, max(vec_id) - min(vec_id) + 1 - count(*) AS n_gaps FROM embeddings GROUP BY 1')
def entity_span(t: Tables) -> DataFrame:
    return position.entity_span(points(t), "label", "pos")


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label <> b.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM s) SELECT vec_id, rank, neighbour, score FROM r WHERE rank <= 32"""
)
def knn_excl_group(t: Tables) -> DataFrame:
    return geometry.knn_exclude_group(t.embeddings, "vec_id", "label", "embedding")


def _asked() -> Column:
    return F.col("vec_id") % 20 == 0


@query()
def knn_index(t: Tables) -> DataFrame:
    """The neighbours that the index finds for every twentieth row; ``knn_index_recall`` holds them against all dot products."""
    index = vectorindex.fit(t.embeddings, "vec_id", "label", "embedding")
    return vectorindex.search(t.embeddings, "vec_id", "label", "embedding", index, queries=_asked())


@query("SELECT count(*) AS n_queries, 32 * count(*) AS n_found, true AS reached, true AS scores_agree FROM embeddings WHERE vec_id % 20 = 0")
def knn_index_recall(t: Tables) -> DataFrame:
    """Whether the index finds 95 % of the true neighbours of every twentieth row, each with its true score."""
    found = written(knn_index(t), "found")
    exact = written(geometry.knn_exclude_group(t.embeddings, "vec_id", "label", "embedding", queries=_asked()), "exact")
    both = exact.join(found.select("vec_id", "neighbour", F.col("score").alias("s")).hint("merge"), ["vec_id", "neighbour"], "left")
    told = both.agg(F.avg(F.col("s").isNotNull().cast("int")).alias("recall"), F.coalesce(F.bool_and(F.abs(F.col("s") - F.col("score")) <= 1e-6), F.lit(True)).alias("scores_agree"))
    sizes = found.agg(F.count_distinct("vec_id").alias("n_queries"), F.count("*").alias("n_found"))
    return sizes.crossJoin(told).select("n_queries", "n_found", (F.col("recall") >= 0.95).alias("reached"), "scores_agree")


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_AT = {frozenset(ij): k for k, ij in enumerate(_PAIRS, 1)}
#: The square of a symmetric matrix that is given by its upper half.
_SQUARE = "[" + ", ".join(" + ".join(f"m[{_AT[frozenset((i, k))]}] * m[{_AT[frozenset((k, j))]}]" for k in range(4)) for i, j in _PAIRS) + "]"
_TRACE = "(m[1] + m[5] + m[8] + m[10])"
CONFORMER_SQL = f"""WITH RECURSIVE {POINTS},
mods AS (SELECT label, k AS m, pos, x * cos(t) - y * sin(t) + CASE WHEN k = 3 THEN 0.05 * sin(CAST(pos AS DOUBLE)) ELSE 0 END AS x, x * sin(t) + y * cos(t) AS y, z FROM pts, (VALUES (1, 0.0::DOUBLE), (2, 1.4::DOUBLE), (3, 2.1::DOUBLE)) v(k, t)),
few AS (SELECT label FROM pts GROUP BY label HAVING count(*) >= 10),
pairs AS (SELECT a.label, a.m, a.pos, a.x, a.y, a.z, b.x AS tx, b.y AS ty, b.z AS tz FROM mods a JOIN mods b ON a.label = b.label AND a.pos = b.pos AND b.m = 1 WHERE a.label IN (FROM few)),
c AS (SELECT label, m, {", ".join(f"covar_pop({u}, t{v}) AS {u}{v}" for u in "xyz" for v in "xyz")}, {", ".join(f"avg({u}) AS c{u}, avg(t{u}) AS g{u}" for u in "xyz")},
  ({" + ".join(f"var_pop({u}) + var_pop(t{u})" for u in "xyz")}) / 2 AS s FROM pairs GROUP BY label, m),
pw AS (SELECT label, m AS model, 0 AS step, [s + xx + yy + zz, yz - zy, zx - xz, xy - yx, s + xx - yy - zz, xy + yx, zx + xz, s + yy - xx - zz, yz + zy, s + zz - xx - yy] AS m FROM c
  UNION ALL SELECT label, model, step + 1, [v / {_TRACE} for v in m] FROM (SELECT label, model, step, {_SQUARE} AS m FROM (SELECT label, model, step, [v / {_TRACE} for v in m] AS m FROM pw WHERE step < 40))),
top AS (SELECT label, model, m, greatest(m[1], m[5], m[8], m[10]) AS d FROM pw WHERE step = 40),
q AS (SELECT label, model, CASE d WHEN m[1] THEN [m[1], m[2], m[3], m[4]] WHEN m[5] THEN [m[2], m[5], m[6], m[7]] WHEN m[8] THEN [m[3], m[6], m[8], m[9]] ELSE [m[4], m[7], m[9], m[10]] END AS q FROM top),
r AS (SELECT label, model, q[1] / n AS w, q[2] / n AS a, q[3] / n AS b, q[4] / n AS e FROM (SELECT *, sqrt(list_dot_product(q, q)) AS n FROM q)),
laid AS (SELECT p.label, p.m, p.pos,
  (w*w + a*a - b*b - e*e) * (p.x - cx) + 2 * (a*b - w*e) * (p.y - cy) + 2 * (a*e + w*b) * (p.z - cz) + gx AS x,
  2 * (a*b + w*e) * (p.x - cx) + (w*w - a*a + b*b - e*e) * (p.y - cy) + 2 * (b*e - w*a) * (p.z - cz) + gy AS y,
  2 * (a*e - w*b) * (p.x - cx) + 2 * (b*e + w*a) * (p.y - cy) + (w*w - a*a - b*b + e*e) * (p.z - cz) + gz AS z
  FROM pairs p JOIN c ON c.label = p.label AND c.m = p.m JOIN r ON r.label = p.label AND r.model = p.m),
mid AS (SELECT label, pos, median(x) AS x, median(y) AS y, median(z) AS z FROM laid GROUP BY label, pos),
off AS (SELECT l.label, l.m, sqrt(avg((l.x - d.x) * (l.x - d.x) + (l.y - d.y) * (l.y - d.y) + (l.z - d.z) * (l.z - d.z))) AS rmsd FROM laid l JOIN mid d ON d.label = l.label AND d.pos = l.pos GROUP BY l.label, l.m),
best AS (SELECT label, arg_min(m, (round(rmsd, 9), m)) AS m, min(rmsd) AS rmsd FROM off GROUP BY label)
SELECT a.label, coalesce(b.m, 1) AS model, round(b.rmsd, 6) AS rmsd FROM (SELECT DISTINCT label FROM pts) a LEFT JOIN best b ON a.label = b.label"""


@query(CONFORMER_SQL)
def best_conformer(t: Tables) -> DataFrame:
    """Each label's points as three models, two of them turned and one also distorted; models 1 and 2 agree."""
    p = points(t).withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    turn = F.when(F.col("model") == 1, 0.0).otherwise(F.col("model") * 0.7)
    bump = F.when(F.col("model") == 3, 0.05 * F.sin(F.col("pos").cast("double"))).otherwise(0.0)
    p = p.select("label", "model", "pos", (F.col("x") * F.cos(turn) - F.col("y") * F.sin(turn) + bump).alias("x"), (F.col("x") * F.sin(turn) + F.col("y") * F.cos(turn)).alias("y"), "z")
    return r6(sequence.best_conformer(p, "label", "model", "pos", ["x", "y", "z"]), "rmsd")


@query("SELECT event_id, value * 2 + 1 AS predicted FROM events")
def score_batches(t: Tables) -> DataFrame:
    return scoring.score_batches(t.events.select("event_id", "value"), lambda f: f["value"] * 2 + 1).select("event_id", "predicted")


@query(f"SELECT {fold_sql('CAST(vec_id AS VARCHAR)')} AS fold, count(*) AS n_rows, CAST(sum(21) AS BIGINT) AS n_atoms FROM embeddings GROUP BY 1")
def feature_store(t: Tables) -> DataFrame:
    """Residue features written by fold beside their statistics, and read back."""
    import uuid

    from residua.operators.stats import norm_stats
    from residua.scratch import scratch_dir
    from residua.sources.files import read_feature_store, write_feature_store

    features = residues(t).withColumn("fold", md5_fold(F.col("pos"), 5))
    stats = norm_stats(points(t).withColumn("col", F.lit("x")), "col", "x")
    path = f"{scratch_dir(t.spark)}/store-{uuid.uuid4().hex}"
    write_feature_store(features, stats, path, order=["label", "pos"])
    back, _ = read_feature_store(t.spark, path)
    return back.groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum(F.size("atoms")).alias("n_atoms"))


@query(f"SELECT {fold_sql('CAST(vec_id AS VARCHAR)')} AS fold, count(*) AS n FROM embeddings WHERE vec_id % 9 <> 0 GROUP BY 1")
def write_by_fold(t: Tables) -> DataFrame:
    """One partition for each fold; rows without a fold are not written."""
    import uuid

    from residua.scratch import scratch_dir

    rows = points(t).withColumn("fold", F.when(F.col("pos") % 9 == 0, -1).otherwise(md5_fold(F.col("pos"), 5)))
    path = f"{scratch_dir(t.spark)}/folds-{uuid.uuid4().hex}"
    splits.write_by_fold(rows, path)
    return t.spark.read.parquet(path).groupBy("fold").agg(F.count("*").alias("n"))
