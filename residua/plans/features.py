"""Feature assembly, serving parity, fixed constants, reports and the losses by residue, on the embeddings and their neighbours."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import constants as C
from residua.functions import expressions as X
from residua.operators import features, geometry, metrics, parity, position, quality, split, stats
from residua.plans.geometry import ATOMS, BONDS, DIST, KNN, NAMES, _bond, knn, points, residues
from residua.plans.measures import BASE, BASE_SQL, EV_FOLD, PRED, fold_sql, folded, predictions, r6
from residua.plans.registry import Tables, query
from residua.scratch import scratch_dir, written
from residua.sources import files

#: Cut-offs that suit points of a unit sphere.
CUTS = {"heavy": 0.35, "h": 0.25}
TARGETS, REPORT = ["t_ca", "t_n", "t_x"], ["acc"]


def _pick(words: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in words]), index.cast("int"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in words) + "]"


def feature_rows(t: Tables) -> DataFrame:
    """A joined row for each vector: codes, angles, a report column and targets, with holes."""
    i, e = F.col("vec_id"), lambda k: F.col("embedding")[k].cast("double")
    hole = lambda n, x: F.when(i % n != 0, x)
    return t.embeddings.select(
        "label", i.alias("pos"), _pick(C.RESIDUES, i % 22).alias("code"), _pick(C.STRUCTURE_CLASSES, i % 10).alias("ss"), _pick(C.MAPPING_CLASSES, i % 6).alias("kind"),
        hole(11, e(0) * 180).alias("phi"), (e(1) * 180).alias("psi"), hole(13, e(29)).alias("acc"), hole(7, e(9) * 10).alias("t_ca"), hole(5, e(19) * 5).alias("t_n"), hole(3, e(20)).alias("t_x"),
    )


def train_stats(rows: DataFrame) -> DataFrame:
    """Of the rows out of fold 1, for all columns but t_x."""
    long = stats.unpivot(rows.where(X.md5_fold(F.col("pos"), 5) != 1), ["pos"], ["t_ca", "t_n", "acc"])
    return stats.norm_stats(long, "col", "value")


def feature_table(t: Tables, targets: list[str], atoms: DataFrame, given: DataFrame | None = None) -> DataFrame:
    rows = feature_rows(t)
    given = train_stats(rows) if given is None else given
    return features.residue_features(rows if targets else rows.drop(*TARGETS), atoms, given, "label", "pos", targets, REPORT, **CUTS)


def _z_sql(c: str) -> str:
    return f"round(coalesce(greatest(-10.0, least(10.0, ({c} - m_{c}) / s_{c})), 0.0), 6)"


@query(
    f"""WITH {ATOMS}, {KNN}, {BONDS},
r AS (SELECT label, vec_id AS pos, ({_sql_list(C.RESIDUES)})[vec_id % 22 + 1] AS code, coalesce(({_sql_list(C.STRUCTURE_CLASSES)})[vec_id % 10 + 1], 'C') AS ss, ({_sql_list(C.MAPPING_CLASSES)})[vec_id % 6 + 1] AS kind,
  CASE WHEN vec_id % 11 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 180 END AS phi, CAST(embedding[2] AS DOUBLE) * 180 AS psi, CASE WHEN vec_id % 13 <> 0 THEN CAST(embedding[30] AS DOUBLE) END AS acc,
  CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[10] AS DOUBLE) * 10 END AS t_ca, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding[20] AS DOUBLE) * 5 END AS t_n, {fold_sql('CAST(vec_id AS VARCHAR)')} AS fold FROM embeddings),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, greatest(stddev_samp({c}), 0.1) AS s_{c}' for c in ('acc', 't_ca', 't_n'))} FROM r WHERE fold <> 1),
pairs AS (SELECT a.vec_id AS pos, count(*) AS n_pairs, sum(greatest(-5.0, least(10.0, {DIST.format(a='a', b='b')} / 10.0))) AS pair_sum FROM atom a JOIN atom b ON a.vec_id = b.vec_id AND a.atom < b.atom AND NOT (a.h AND b.h) GROUP BY 1),
cloud AS (SELECT a.vec_id AS pos, avg({DIST.format(a='a', b='c')}) AS mean FROM atom a JOIN atom c ON a.vec_id = c.vec_id AND c.atom = 'CA' WHERE a.atom NOT IN ('N', 'CA', 'C', 'O', 'H', 'HA') GROUP BY 1),
ca AS (SELECT label, vec_id AS pos, x, y, z FROM atoms WHERE atom = 'CA'),
near AS (SELECT a.label, a.pos, b.pos AS neighbour, {DIST.format(a='a', b='b')} AS dist, row_number() OVER (PARTITION BY a.label, a.pos ORDER BY {DIST.format(a='a', b='b')}, b.pos) - 1 AS slot FROM ca a JOIN ca b ON a.label = b.label AND abs(a.pos - b.pos) >= 4),
five AS (SELECT * FROM near WHERE slot < 5),
spatial AS (SELECT pos, string_agg(CAST(neighbour AS VARCHAR), ' ' ORDER BY slot) AS neighbours, round(sum(dist), 6) AS near_sum FROM five GROUP BY 1),
windows AS (SELECT a.pos, string_agg(CAST(b.pos AS VARCHAR), ' ' ORDER BY b.pos) AS window_pos FROM pts a JOIN pts b ON a.label = b.label AND abs(a.pos - b.pos) <= 5 GROUP BY 1),
part AS (SELECT a.label, a.pos, b.pos AS partner, b.pos - a.pos + 6 AS code FROM pts a JOIN pts b ON a.label = b.label AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 5 UNION ALL SELECT label, pos, neighbour, slot + 12 FROM five WHERE abs(neighbour - pos) > 5),
cp AS (SELECT p.pos, p.code, a.atom AS a1, b.atom AS a2, {DIST.format(a='a', b='b')} AS d, a.h OR b.h AS h FROM part p JOIN atom a ON a.vec_id = p.pos JOIN atom b ON b.vec_id = p.partner WHERE NOT (a.h AND b.h) AND a.atom <> '1HG1' AND b.atom <> '1HG1'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d, code, a1, a2) AS i FROM cp WHERE d <= CASE WHEN h THEN 0.25 ELSE 0.35 END),
crossed AS (SELECT pos, count(*) AS n_cross, sum(d / 10.0) AS cross_sum, CAST(sum(code) AS BIGINT) AS code_sum FROM ranked WHERE i <= 600 GROUP BY 1),
own AS (SELECT label, vec_id AS pos, {', '.join(f"max({c}) FILTER (atom = '{a}') AS {p}{c}" for a, p in (('CA', 'ca'), ('C', 'c'), ('N', 'n')) for c in 'xyz')} FROM atoms GROUP BY 1, 2),
chain AS (SELECT *, {', '.join(f'lag({a}{c}) OVER v AS p{a}{c}, lead({a}{c}) OVER v AS f{a}{c}' for a in ('ca', 'c', 'n') for c in 'xyz')}, lag(pos) OVER v = pos - 1 AS back, lead(pos) OVER v = pos + 1 AS forth FROM own WINDOW v AS (PARTITION BY label ORDER BY pos))
SELECT r.label, r.pos, CAST(coalesce(list_position({_sql_list(C.RESIDUES)}, code) - 1, 20) AS INTEGER) AS code_idx, CAST(coalesce(list_position({_sql_list(C.STRUCTURE_CLASSES)}, ss) - 1, {len(C.STRUCTURE_CLASSES)}) AS INTEGER) AS ss_idx,
  CAST(coalesce(list_position({_sql_list(C.MAPPING_CLASSES)}, kind) - 1, 5) AS INTEGER) AS kind_idx,
  {_z_sql('acc')} AS z_acc, {_z_sql('t_ca')} AS z_ca, {_z_sql('t_n')} AS z_n, 0.0::DOUBLE AS z_x, t_ca IS NOT NULL AND coalesce(kind NOT IN ('gap_in_structure', 'mismatch'), true) AS m_ca, t_n IS NOT NULL AND coalesce(kind NOT IN ('gap_in_structure', 'mismatch'), true) AS m_n, false AS m_x,
  round(coalesce(sin(radians(phi)), 0), 6) AS sin_phi, round(coalesce(cos(radians(phi)), 0), 6) AS cos_phi, round(sin(radians(psi)), 6) AS sin_psi, round(cos(radians(psi)), 6) AS cos_psi,
  window_pos, neighbours, near_sum, CAST(n_pairs AS INTEGER) AS n_pairs, round(pair_sum, 6) AS pair_sum, round(mean, 6) AS side_mean,
  round(CASE WHEN back THEN {_bond('ca', 'pca')} / 10 ELSE 0 END, 6) AS bond_prev, round(CASE WHEN forth THEN {_bond('ca', 'fca')} / 10 ELSE 0 END, 6) AS bond_next, round(CASE WHEN forth THEN {_bond('c', 'fn')} / 10 ELSE 0 END, 6) AS bond_fwd, round(CASE WHEN back THEN {_bond('pc', 'n')} / 10 ELSE 0 END, 6) AS bond_bkwd,
  CAST(n_cross AS INTEGER) AS n_cross, round(cross_sum, 6) AS cross_sum, code_sum
FROM r CROSS JOIN st LEFT JOIN pairs ON pairs.pos = r.pos LEFT JOIN cloud ON cloud.pos = r.pos LEFT JOIN spatial ON spatial.pos = r.pos LEFT JOIN windows ON windows.pos = r.pos LEFT JOIN crossed ON crossed.pos = r.pos LEFT JOIN chain ON chain.pos = r.pos"""
)
def residue_features(t: Tables) -> DataFrame:
    f = feature_table(t, TARGETS, residues(t))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    words = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    no_atoms = F.filter("pairs", lambda z: z["d"].isNotNull())
    out = f.select(
        "label", "pos", "code_idx", "ss_idx", "kind_idx", F.col("report_z")[0].alias("z_acc"), *[F.col("target_z")[i].alias(f"z_{c[2:]}") for i, c in enumerate(TARGETS)], *[F.col("target_mask")[i].alias(f"m_{c[2:]}") for i, c in enumerate(TARGETS)],
        *[F.col("angles")[i].alias(c) for i, c in enumerate(("sin_phi", "cos_phi", "sin_psi", "cos_psi"))], words(F.col("window.pos")).alias("window_pos"), words(F.col("neighbours.neighbour")).alias("neighbours"),
        total(F.col("neighbours.dist")).alias("near_sum"), F.size(no_atoms).alias("n_pairs"), total(F.col("pairs.d")).alias("pair_sum"), F.col("cloud.mean").alias("side_mean"),
        *[F.col("bonds")[i].alias(c) for i, c in enumerate(("bond_prev", "bond_next", "bond_fwd", "bond_bkwd"))], F.when(F.size("cross") > 0, F.size("cross")).alias("n_cross"),
        F.when(F.size("cross") > 0, total(F.col("cross.d"))).alias("cross_sum"), F.when(F.size("cross") > 0, F.aggregate(F.col("cross.code"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("code_sum"),
    )
    return r6(out, *[c for c, k in out.dtypes if k == "double"])


@query("SELECT side, 0::BIGINT AS n_missing, (SELECT count(*) FROM embeddings) AS n_rows FROM (VALUES ('serving'), ('training')) s(side)")
def feature_parity(t: Tables) -> DataFrame:
    """Training features, read back from the store, and those that serving makes from loose atoms without targets: how many rows of each the other lacks."""
    path = f"{scratch_dir(t.spark)}/store-{uuid.uuid4().hex}"
    # written once: sums of doubles follow the order of their rows, so statistics taken twice differ in their last bits
    own = written(train_stats(feature_rows(t)), "stats")
    train = feature_table(t, TARGETS, residues(t), own).withColumn("fold", X.md5_fold(F.col("pos"), 5))
    files.write_feature_store(train, own, path)
    train, given = files.read_feature_store(t.spark, path)
    atoms = residues(t).select("label", "pos", F.explode(F.shuffle("atoms")).alias("z")).select("label", "pos", "z.*")
    serve = features.residue_features(feature_rows(t).drop(*TARGETS), geometry.atom_arrays(atoms, ["label", "pos"]), given, "label", "pos", [], REPORT, **CUTS).drop("target_z", "target_mask")
    serve = written(serve, "serving")
    return parity.differences(serve, train.select(serve.columns), ["label", "pos"], ("serving", "training"))


#: Target columns of the loss by residue, and the fixed groups and pairs as SQL rows.
KINDS = "HD1 HD2 HE1 HE2 HB2 HB3 HG2 HG3 CD1 CD2".split()
EQUIVALENT_SQL = ", ".join(f"('{r}', '{a}', '{g}')" for r, gs in C.EQUIVALENT.items() for g in gs for a in g.split())
SWAPPABLE_SQL = ", ".join(f"('{r}', '{x.split()[i]}', '{x.split()[1 - i]}')" for r, xs in C.SWAPPABLE.items() for x in xs for i in (0, 1))
_HUBER = "CASE WHEN abs({e}) <= 0.5 THEN 0.5 * ({e}) * ({e}) ELSE 0.5 * (abs({e}) - 0.25) END"


@query(
    f"""WITH eq(residue, kind, grp) AS (VALUES {EQUIVALENT_SQL}), sw(residue, kind, other) AS (VALUES {SWAPPABLE_SQL}),
c AS (SELECT vec_id, ({_sql_list(C.RESIDUES)})[vec_id % 20 + 1] AS residue, ({_sql_list(KINDS)})[i] AS kind, CAST(embedding[i] AS DOUBLE) * 8 AS y, CAST(embedding[i + 10] AS DOUBLE) * 8 AS p FROM embeddings, range(1, 11) r(i) WHERE (vec_id + i) % 4 <> 0),
s AS (SELECT residue, grp, count(*) AS n FROM eq WHERE kind IN ({', '.join(f"'{k}'" for k in KINDS)}) GROUP BY 1, 2),
l AS (SELECT 1.0 / coalesce(s.n, 1) AS w, CASE WHEN m.y IS NULL THEN {_HUBER.format(e='c.p - c.y')}
  ELSE 0.5 * least({_HUBER.format(e='c.p - c.y')} + {_HUBER.format(e='m.p - m.y')}, {_HUBER.format(e='c.p - m.y')} + {_HUBER.format(e='m.p - c.y')}) END AS loss
  FROM c LEFT JOIN eq ON eq.residue = c.residue AND eq.kind = c.kind LEFT JOIN s ON s.residue = eq.residue AND s.grp = eq.grp LEFT JOIN sw ON sw.residue = c.residue AND sw.kind = c.kind LEFT JOIN c m ON m.vec_id = c.vec_id AND m.kind = sw.other)
SELECT round(avg(loss * w), 6) AS loss, count(*) AS n FROM l"""
)
def swap_huber_by_residue(t: Tables) -> DataFrame:
    """What is equivalent or swappable is so in some residues only."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), (F.col("embedding")[i - 1].cast("double") * 8).alias("y"), (F.col("embedding")[i + 9].cast("double") * 8).alias("p")) for i, k in enumerate(KINDS, 1)])
    c = t.embeddings.select("vec_id", _pick(C.RESIDUES, F.col("vec_id") % 20).alias("residue"), F.explode(cells).alias("z")).select("vec_id", "residue", "z.*").where((F.col("vec_id") + F.col("i")) % 4 != 0)
    groups, pairs = metrics.loss_tables(t.spark)
    return r6(metrics.swap_huber(c, ["vec_id"], "kind", "y", "p", groups, pairs, residue="residue", present=KINDS), "loss")


CONSTANT_ATOMS = ["CA", "N", "MB", "MD1", "CG"]
CONSTANT_COLS = ["ca_shift", "n_shift", "hb1_shift", "hd11_shift", "cg_shift", "hz_shift"]
THREE = {one: three for three, one in C.ONE_LETTER.items()}
COIL_SQL = ", ".join(f"('{THREE[r]}', '{a}', CAST({v} AS DOUBLE))" for r, values in C.RANDOM_COIL.items() for a, v in zip(C.RANDOM_COIL_ATOMS, values, strict=True) if v is not None)
METHYL_SQL = ", ".join(f"('{a}', '{m}', {i})" for a, ms in C.METHYL_ALIASES.items() for i, m in enumerate(ms, 1))


@query(
    f"""WITH k AS (SELECT ({_sql_list(C.RESIDUES)})[label % 20 + 1] AS residue, ({_sql_list(CONSTANT_ATOMS)})[vec_id % 5 + 1] AS atom, CASE WHEN min((label + vec_id) % 5) <> 1 THEN round(avg(CAST(embedding[1] AS DOUBLE)) * 100, 3) END AS center, CASE WHEN min((label + vec_id) % 5) <> 1 THEN round(stddev_samp(CAST(embedding[2] AS DOUBLE)), 3) END AS scale FROM embeddings GROUP BY 1, 2),
known AS (SELECT * FROM k WHERE center IS NOT NULL OR scale IS NOT NULL),
coil(residue, atom, shift) AS (VALUES {COIL_SQL}), alias(atom, name, rank) AS (VALUES {METHYL_SQL}),
st AS (SELECT col, avg(v) AS m, greatest(stddev_samp(v), 0.1) AS s, count(v) AS n FROM (SELECT 'ca_shift' AS col, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings UNION ALL SELECT 'hz_shift', CAST(embedding[4] AS DOUBLE) * 40 FROM embeddings) GROUP BY 1),
w AS (SELECT residue, col, upper(replace(col, '_shift', '')) AS atom FROM (SELECT unnest({_sql_list(C.RESIDUES)}) AS residue), (SELECT unnest({_sql_list(CONSTANT_COLS)}) AS col)),
tried AS (SELECT residue, col, atom AS name, 0 AS rank FROM w UNION ALL SELECT residue, col, a.name, a.rank FROM w JOIN alias a USING (atom)),
hit AS (SELECT residue, col, arg_min(center, rank) AS center, arg_min(scale, rank) AS scale FROM (SELECT t.residue, col, rank, coalesce(center, 1e300) AS center, coalesce(scale, 1e300) AS scale FROM tried t JOIN known k ON k.residue = t.residue AND k.atom = t.name) GROUP BY 1, 2)
SELECT 'group' AS scope, w.residue AS "group", w.col, NULL::BIGINT AS n, round(coalesce(shift, nullif(center, 1e300), m, 0), 6) AS mean, round(greatest(coalesce(nullif(scale, 1e300), s, 1.0), 0.1), 6) AS std, 'fixed' AS normalization
FROM w LEFT JOIN hit ON hit.residue = w.residue AND hit.col = w.col LEFT JOIN coil ON coil.residue = w.residue AND coil.atom = w.atom LEFT JOIN st ON st.col = w.col
UNION ALL SELECT 'global', NULL, col, n, round(m, 6), round(s, 6), 'fixed' FROM st"""
)
def fixed_constants(t: Tables) -> DataFrame:
    """A table of centers and scales, some of them empty, written as CSV, read back, and put in the place of the group statistics."""
    e = lambda i: F.col("embedding")[i].cast("double")
    full = F.min((F.col("label") + F.col("vec_id")) % 5) != 1
    k = t.embeddings.groupBy(_pick(C.RESIDUES, F.col("label") % 20).alias("residue"), _pick(CONSTANT_ATOMS, F.col("vec_id") % 5).alias("atom"))
    k = k.agg(F.when(full, F.round(F.avg(e(0)) * 100, 3)).alias("center"), F.when(full, F.round(F.stddev_samp(e(1)), 3)).alias("scale"))
    path = f"{scratch_dir(t.spark)}/constants-{uuid.uuid4().hex}"
    k.write.csv(path, header=True)
    long = t.embeddings.select(F.explode(F.array(F.struct(F.lit("ca_shift").alias("col"), e(2).alias("v")), F.struct(F.lit("hz_shift").alias("col"), (e(3) * 40).alias("v")))).alias("z")).select("z.*")
    given = stats.norm_stats(long, "col", "v")
    base = X.random_coil(t.spark).withColumn("residue", F.try_element_at(X.literal_map(THREE), F.col("residue")))
    return r6(stats.fixed_stats(given, stats.read_constants(t.spark, path), base, C.RESIDUES, CONSTANT_COLS, "fixed"), "mean", "std")


@query(
    f"""WITH {KNN}, s AS (SELECT vec_id AS pos, label, CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 4 <> 0 THEN CAST(embedding[2] AS DOUBLE) END AS b FROM embeddings),
g AS (SELECT k.pos, string_agg(CAST(k.neighbour AS VARCHAR), ' ' ORDER BY slot) AS ids, count(s.a) AS near_a, count(s.b) AS near_b, round(sum(coalesce(s.a, 0)), 6) AS sum_a FROM knn k JOIN s ON s.label = k.label AND s.pos = k.neighbour GROUP BY 1),
x AS (SELECT a.pos, count(*) AS n_window, count(b.a) AS win_a, count(b.b) AS win_b FROM s a JOIN s b ON a.label = b.label AND abs(a.pos - b.pos) <= 5 GROUP BY 1),
u AS (SELECT label, pos, 'a' AS nucleus, a AS target FROM s WHERE a IS NOT NULL UNION ALL SELECT label, pos, 'b', b FROM s WHERE b IS NOT NULL)
SELECT u.label, u.pos, nucleus, round(target, 6) AS target, n_window, win_a - CAST(nucleus = 'a' AS BIGINT) AS win_a, win_b - CAST(nucleus = 'b' AS BIGINT) AS win_b, ids, near_a, near_b, sum_a FROM u JOIN x ON x.pos = u.pos LEFT JOIN g ON g.pos = u.pos"""
)
def impute_samples_spatial(t: Tables) -> DataFrame:
    """Samples with the window, its own target hidden, and the spatial neighbours' targets, unmasked."""
    e = lambda i: F.col("embedding")[i].cast("double")
    s = t.embeddings.select("label", F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 3 != 0, e(0)).alias("a"), F.when(F.col("vec_id") % 4 != 0, e(1)).alias("b"))
    out = position.impute_samples(s, "label", "pos", ["a", "b"], neighbours=knn(t))
    seen = lambda c, x: F.size(F.filter(c, lambda z: z[x].isNotNull())).cast("long")
    total = F.aggregate("near", F.lit(0.0), lambda acc, z: acc + F.coalesce(z["a"], F.lit(0.0)))
    out = out.select(
        "label", "pos", "nucleus", "target", F.size("context").cast("long").alias("n_window"), seen("context", "a").alias("win_a"), seen("context", "b").alias("win_b"),
        F.array_join(F.transform("near", lambda z: z["neighbour"].cast("string")), " ").alias("ids"), seen("near", "a").alias("near_a"), seen("near", "b").alias("near_b"), total.alias("sum_a"),
    )
    return r6(out, "target", "sum_a")


@query(f"WITH {EV_FOLD}, {BASE_SQL}, ev AS (SELECT event_id, event_type, value, CAST(user_id % 3 AS VARCHAR) AS grp FROM events) SELECT event_id, round(value - shift, 6) AS secondary FROM ev LEFT JOIN base USING (grp, event_type)")
def secondary_shift(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", "value", (F.col("user_id") % 3).cast("string").alias("grp"))
    base = t.spark.createDataFrame(BASE, "residue string, atom string, shift double")
    return r6(stats.secondary_shift(e, base, "grp", "event_type", "value").select("event_id", "secondary"), "secondary")


@query(f"WITH a AS (SELECT ({_sql_list(NAMES)})[i] AS atom, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {len(NAMES) + 1}) r(i)) SELECT atom, atom IN ({', '.join(repr(x) for x in C.BACKBONE)}) AS backbone, count(*) AS n, round(avg(v), 6) AS mean FROM a GROUP BY 1, 2")
def column_atoms(t: Tables) -> DataFrame:
    """Columns named after atoms, back to atoms with their backbone flag."""
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"{n.lower()}_shift") for i, n in enumerate(NAMES)])
    long = stats.unpivot(wide, ["vec_id"], wide.columns[1:]).withColumn("atom", X.atom_of(F.col("col")))
    return r6(long.groupBy("atom", X.is_backbone(F.col("atom")).alias("backbone")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("WITH p AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',') AS x FROM orders GROUP BY 1) SELECT CAST(o_custkey AS VARCHAR) AS id, 'K' || CAST(o_orderkey AS VARCHAR) AS item FROM orders")
def pairs_csv(t: Tables) -> DataFrame:
    """Pair lists written as CSV with a quoted header, empty items and blanks, and read back."""
    path = f"{scratch_dir(t.spark)}/pairs-{uuid.uuid4().hex}"
    items = F.concat(F.lit(" k"), F.array_join(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))), ", k"), F.lit(",, nan"))
    lists = t.orders.groupBy(F.col("o_custkey").cast("string").alias("Entry_ID")).agg(items.alias("pdb_ids"))
    lists.write.csv(path, header=True, quoteAll=True)
    return files.read_pairs(t.spark, path)


@query(f"WITH {PRED} SELECT event_type, round(avg(abs(p - y)), 6) AS mae, count(*) AS n, 'mean' AS model, 1::BIGINT AS fold, '2024-01-01' AS made_at FROM preds GROUP BY 1")
def metric_report(t: Tables) -> DataFrame:
    """A metric table written as a report with where it comes from, and read back."""
    path = f"{scratch_dir(t.spark)}/report-{uuid.uuid4().hex}"
    m = r6(metrics.metrics(predictions(t), "y", "p", ["event_type"]).select("event_type", "mae", "n"), "mae")
    metrics.write_report(m, path, "mean", 1, "2024-01-01")
    return t.spark.read.schema("event_type string, mae double, n long, model string, fold long, made_at string").json(path)


@query(
    f"""WITH {EV_FOLD}, u AS (SELECT user_id, any_value(fold) AS fold, count(*) AS n FROM events_f GROUP BY 1)
SELECT 'stamped' AS gate, count(*) FILTER (fold > 2) AS n_rows, true AS passed FROM u UNION ALL SELECT 'not stamped', count(*), count(*) FILTER (fold <= 2) = 0 FROM u
UNION ALL SELECT 'leaks', count(*), true FROM u UNION ALL SELECT 'empty', count(*) FILTER (fold > 9), true FROM u"""
)
def fail_closed(t: Tables) -> DataFrame:
    """Each gate on a table that passes or fails it: a split with its stamp, one without, a split without leaks, an empty list of offenders."""
    u = folded(t).groupBy("user_id").agg(F.max("fold").alias("fold"))
    stamped = quality.stamp_folds(u.select("user_id"), u.where("fold > 2"), "user_id")

    comps = u.select(F.col("user_id").alias("id"), "fold", F.col("user_id").alias("component"))
    groups = u.select(F.col("user_id").alias("id"), F.col("user_id").alias("grp"))
    none = u.where("fold > 9").select(F.col("user_id").alias("id"))
    unmarked = F.col("provenance") != "stamped"
    leaks = split.leakage_report(comps, groups, none).agg(F.sum("n").alias("n_bad"))
    gates = [
        quality.gate(stamped.where("fold > 2"), "stamped", unmarked, 1),
        quality.gate(stamped, "not stamped", unmarked, 1),
        quality.gate(comps, "leaks", F.lit(False)).drop("n_bad", "passed").crossJoin(F.broadcast(leaks)).withColumn("passed", F.col("n_bad") == 0),
        quality.gate(none, "empty", F.lit(True)),
    ]
    return reduce(DataFrame.unionByName, gates).select("gate", "n_rows", "passed")


SEQS = """o AS (SELECT conv_id, turn, min(upper(substr(role, 1, 1))) AS l FROM conversations GROUP BY 1, 2), q AS (SELECT conv_id, string_agg(l, '' ORDER BY turn) AS seq FROM o GROUP BY 1),
s AS (SELECT a.conv_id, a.seq AS a, b.seq AS b FROM q a JOIN q b ON b.conv_id = a.conv_id + 1)"""


@query(
    f"""WITH RECURSIVE {SEQS},
dp AS (SELECT conv_id, a, b, 0 AS i, [CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE -2.0 - 0.5 * (j - 1) END for j in range(length(b) + 1)] AS best, [-1e18::DOUBLE for j in range(length(b) + 1)] AS down FROM s
UNION ALL SELECT conv_id, a, b, i + 1, [greatest(two[j + 1], coalesce(list_max([two[k + 1] - 2.0 - 0.5 * (j - k - 1) for k in range(j)]), -1e18)) for j in range(length(b) + 1)], one FROM (
  SELECT *, [greatest(one[j + 1], CASE WHEN j = 0 THEN -1e18 ELSE best[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN 2.0 ELSE -1.0 END END) for j in range(length(b) + 1)] AS two FROM (
    SELECT *, [greatest(best[j + 1] - 2.0, down[j + 1] - 0.5) for j in range(length(b) + 1)] AS one FROM dp WHERE i < length(a))))
SELECT conv_id, CAST(best[length(b) + 1] AS DOUBLE) AS score, length(a) AS n_a, length(b) AS n_b FROM dp WHERE i = length(a)"""
)
def align_scores(t: Tables) -> DataFrame:
    """The scores of the alignments, by dynamic programming in SQL; and both strings come back when the gaps are taken out."""
    from residua.operators import sequence
    from residua.plans.reshape import paired

    out = sequence.align_pairs(paired(t).select("conv_id", "seq", "seq_b"), "seq", "seq_b")
    n = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    return out.select("conv_id", "score", n("gapped_a").cast("long").alias("n_a"), n("gapped_b").cast("long").alias("n_b"))


@query(
    """WITH m AS (SELECT l_orderkey AS e, l_linenumber AS struct_id, l_linenumber + 1 AS target_id FROM lineitem GROUP BY 1, 2), tg AS (SELECT l_orderkey AS e, l_linenumber AS target_id, min(l_returnflag) AS code FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
st AS (SELECT l_orderkey AS e, l_linenumber AS struct_id, max(l_returnflag) AS code FROM lineitem GROUP BY 1, 2), rp AS (SELECT l_orderkey AS e, l_linenumber AS struct_id, min(l_shipmode_like) AS ss, max(l_tax) AS phi FROM (SELECT *, l_linestatus AS l_shipmode_like FROM lineitem) WHERE l_tax > 0.02 GROUP BY 1, 2),
nb AS (SELECT a.l_orderkey AS e, a.l_linenumber AS struct_id, string_agg(DISTINCT CAST(b.l_linenumber AS VARCHAR), ' ') AS x, count(DISTINCT b.l_linenumber) AS n, sum(DISTINCT b.l_linenumber) AS total FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2)
SELECT m.e, m.struct_id AS pos, m.target_id, coalesce(tg.code, CASE WHEN st.code IN ('A', 'N') THEN st.code END, 'UNK') AS code, ss, phi, CAST(coalesce(nb.n, -1) AS INTEGER) AS n_near, CAST(nb.total AS BIGINT) AS near_sum
FROM m JOIN tg ON tg.e = m.e AND tg.target_id = m.target_id LEFT JOIN st ON st.e = m.e AND st.struct_id = m.struct_id LEFT JOIN rp ON rp.e = m.e AND rp.struct_id = m.struct_id LEFT JOIN nb ON nb.e = m.e AND nb.struct_id = m.struct_id"""
)
def mapped_join_full(t: Tables) -> DataFrame:
    """The alignment join with all five sides: mapping, targets, structure, secondary structure and neighbours."""
    from residua.operators import reshape

    keys = [F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("pos")]
    at = t.lineitem.select(*keys).distinct()
    m = at.select("e", F.col("pos").alias("struct_id"), (F.col("pos") + 1).alias("target_id"))
    targets = t.lineitem.where("l_linestatus = 'O'").groupBy(*keys).agg(F.min("l_returnflag").alias("code"))
    structure = t.lineitem.groupBy(*keys).agg(F.max("l_returnflag").alias("code"))
    report = t.lineitem.where("l_tax > 0.02").groupBy(*keys).agg(F.min("l_linestatus").alias("ss"), F.max("l_tax").alias("phi"))
    near = at.join(at.select("e", F.col("pos").alias("neighbour")).hint("merge"), "e").where("pos < neighbour").withColumn("slot", (F.col("neighbour") - F.col("pos")).cast("int"))
    out = reshape.mapped_join(m, targets, structure, "e", known=["A", "N"], report=report, neighbours=near)
    return out.select("e", "pos", "target_id", "code", "ss", "phi", F.coalesce(F.size("spatial"), F.lit(-1)).alias("n_near"), F.aggregate(F.col("spatial.neighbour"), F.lit(0).cast("long"), lambda a, x: a + x).alias("near_sum"))
