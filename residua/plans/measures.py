"""Statistics, normalisation and metrics on the events table: type = event_type, entity = user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expressions as X
from residua.operators import metrics as M
from residua.operators import quality, stats
from residua.operators.position import loo_split
from residua.plans.registry import Tables, query


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


FOLD = "CAST(('0x' || substr(md5({p}), {i}, 8)) AS BIGINT)"


def fold_sql(key: str, n: int = 5) -> str:
    """1 + md5 mod n in DuckDB, by the same four pieces."""
    out = "0"
    for i in range(4):
        out = f"(({out} * 4294967296 + {FOLD.format(p=key, i=1 + 8 * i)}) % {n})"
    return f"CAST({out} + 1 AS INTEGER)"


EV_FOLD = f"events_f AS (SELECT *, {fold_sql('CAST(user_id AS VARCHAR)')} AS fold FROM events)"
PRED = "preds AS (SELECT event_id, user_id, event_type, value AS y, avg(value) OVER (PARTITION BY user_id) AS p FROM events)"


def folded(t: Tables) -> DataFrame:
    return t.events.withColumn("fold", X.md5_fold(F.col("user_id"), 5))


def predictions(t: Tables) -> DataFrame:
    """Truth and a prediction: the user's mean."""
    e = t.events
    mean = e.groupBy("user_id").agg(F.avg("value").alias("p"))
    return e.select("event_id", "user_id", "event_type", F.col("value").alias("y")).join(mean, "user_id")


@query(
    f"""WITH b AS (SELECT event_type, avg(value) m, stddev_samp(value) s, count(value) n FROM events GROUP BY 1),
clean AS (SELECT e.event_id, e.user_id, e.event_type, CASE WHEN n >= 10 AND s >= 1e-6 AND (value < m - 4 * s OR value > m + 4 * s) THEN NULL ELSE value END AS value,
  {fold_sql('CAST(user_id AS VARCHAR)')} AS fold FROM events e JOIN b USING (event_type)),
st AS (SELECT k AS fold, event_type, avg(value) AS mean, greatest(stddev_samp(value), 0.1) AS std FROM clean, range(1, 6) r(k) WHERE clean.fold <> k GROUP BY 1, 2),
z AS (SELECT c.event_type, greatest(-10.0, least(10.0, (value - mean) / std)) AS z FROM clean c JOIN st ON c.fold = st.fold AND c.event_type = st.event_type WHERE value IS NOT NULL)
SELECT event_type, round(avg(abs(z)), 6) AS mae, round(sqrt(avg(z * z)), 6) AS rmse, count(*) AS n FROM z GROUP BY 1"""
)
def flagship(t: Tables) -> DataFrame:
    """Outliers out, users in hashed folds, statistics of the other folds, z-scores, errors of predicting the mean."""
    clean = quality.null_outliers(t.events, ["value"], quality.group_bounds(t.events, ["value"], "event_type"), "event_type")
    clean = clean.withColumn("fold", X.md5_fold(F.col("user_id"), 5))
    st = stats.train_only_stats(clean, "event_type", "value", "fold", [1, 2, 3, 4, 5]).withColumnsRenamed({"held_out": "fold", "col": "event_type"})
    z = stats.zscore(clean, st, ["fold", "event_type"], "value")
    out = M.metrics(z.withColumn("zero", F.lit(0.0)), "z", "zero", ["event_type"])
    return r6(out.select("event_type", "mae", "rmse", "n"), "mae", "rmse")


@query(
    """SELECT CASE WHEN grouping(user_id) = 1 THEN 'global' ELSE 'group' END AS scope, CAST(user_id AS VARCHAR) AS "group", event_type AS col, count(value) AS n,
  round(coalesce(avg(value), 0), 6) AS mean, round(CASE WHEN count(value) = 0 THEN 1.0 ELSE greatest(coalesce(stddev_samp(value), 0.1), 0.1) END, 6) AS std
FROM events GROUP BY GROUPING SETS ((event_type), (user_id, event_type)) HAVING grouping(user_id) = 1 OR count(value) >= 10"""
)
def norm_stats(t: Tables) -> DataFrame:
    return r6(stats.norm_stats(t.events.withColumn("user_id", F.col("user_id").cast("string")), "event_type", "value", "user_id"), "mean", "std")


@query(
    f"""WITH {EV_FOLD} SELECT CAST(k AS INTEGER) AS held_out, event_type AS col, count(value) AS n, round(avg(value), 6) AS mean, round(greatest(stddev_samp(value), 0.1), 6) AS std
FROM events_f, range(1, 6) r(k) WHERE fold <> k GROUP BY 1, 2"""
)
def train_only_stats(t: Tables) -> DataFrame:
    return r6(stats.train_only_stats(folded(t), "event_type", "value", "fold", [1, 2, 3, 4, 5]), "mean", "std")


@query(
    """WITH s AS (SELECT event_type, avg(value) m, greatest(stddev_samp(value), 0.1) s FROM events GROUP BY 1)
SELECT event_id, round(greatest(-10.0, least(10.0, (value - m) / s)), 6) AS z FROM events JOIN s USING (event_type)"""
)
def zscore(t: Tables) -> DataFrame:
    st = stats.norm_stats(t.events, "event_type", "value").select(F.col("col").alias("event_type"), "mean", "std")
    return r6(stats.zscore(t.events, st, ["event_type"], "value").select("event_id", "z"), "z")


GROUP_STATS = """g AS (SELECT user_id, event_type, avg(value) gm, greatest(stddev_samp(value), 0.1) gs FROM events GROUP BY 1, 2 HAVING count(value) >= 10),
a AS (SELECT event_type, avg(value) am, greatest(stddev_samp(value), 0.1) s FROM events GROUP BY 1),
z AS (SELECT e.event_id, e.user_id, e.event_type, (value - am) / s AS z, am, s, coalesce(gm, am) AS m2, coalesce(gs, s) AS s2, value FROM events e JOIN a USING (event_type) LEFT JOIN g USING (user_id, event_type))"""


def _global_z(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.withColumn("user_id", F.col("user_id").cast("string"))
    st = stats.norm_stats(e, "event_type", "value", "user_id")
    only = st.where("scope = 'global'").select(F.col("col").alias("event_type"), "mean", "std")
    return stats.zscore(e, only, ["event_type"], "value", clip=None), st


@query(f"WITH {GROUP_STATS} SELECT event_id, round((z * s + am - m2) / s2, 6) AS z_group FROM z")
def renormalise(t: Tables) -> DataFrame:
    z, st = _global_z(t)
    return r6(stats.renormalise(z, st, "event_type", "user_id", "z").select("event_id", "z_group"), "z_group")


@query(f"WITH {GROUP_STATS} SELECT event_id, round((value - m2) / s2 * s2 + m2, 6) AS back FROM z")
def denormalise(t: Tables) -> DataFrame:
    z, st = _global_z(t)
    n = stats.normalise(z.drop("z"), st, "event_type", "user_id", "value")
    return r6(stats.denormalise(n, st, "event_type", "user_id", "z", "back").select("event_id", "back"), "back")


@query(f"WITH {PRED} SELECT event_type, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n, round(avg(y), 6) AS mean_true, round(stddev_pop(y), 6) AS std_true FROM preds GROUP BY 1")
def metrics_by_type(t: Tables) -> DataFrame:
    return r6(M.metrics(predictions(t), "y", "p", ["event_type"]), "mae", "rmse", "r2", "mean_true", "std_true")


@query(f"WITH {PRED} SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(quantile_cont(abs(p - y), 0.5), 6) AS median, round(quantile_cont(abs(p - y), 0.95), 6) AS p95, count(*) AS n FROM preds")
def metrics_overall(t: Tables) -> DataFrame:
    return r6(M.metrics_overall(predictions(t), "y", "p"), "mae", "rmse", "median", "p95")


@query(f"WITH {PRED}, e AS (SELECT user_id, avg(abs(p - y)) AS mae FROM preds GROUP BY 1) SELECT count(*) AS n_entities, round(avg(mae), 6) AS mean, round(quantile_cont(mae, 0.5), 6) AS median, round(stddev_pop(mae), 6) AS std, round(min(mae), 6) AS best, round(max(mae), 6) AS worst FROM e")
def metrics_by_entity(t: Tables) -> DataFrame:
    return r6(M.metrics_by_entity(predictions(t), "y", "p", "user_id"), "mean", "median", "std", "best", "worst")


#: A small base table for the stand-ins: a value for each (group, type), with holes.
BASE = [("0", "click", 10.0), ("0", "view", 20.0), ("1", "click", 12.0), ("1", "error", 30.0), ("2", "view", 25.0), ("2", "click", 8.0)]
BASE_SQL = "base(grp, event_type, shift) AS (VALUES " + ", ".join(f"('{g}', '{k}', CAST({v} AS DOUBLE))" for g, k, v in BASE) + ")"


@query(
    f"""WITH {EV_FOLD}, {BASE_SQL}, ev AS (SELECT event_type, value, fold, CAST(user_id % 3 AS VARCHAR) AS grp FROM events_f),
m AS (SELECT event_type, avg(value) p FROM ev WHERE fold <> 1 GROUP BY 1), bm AS (SELECT event_type, avg(shift) p FROM base GROUP BY 1),
rows AS (SELECT event_type, 'train_mean' AS baseline, value, p FROM ev JOIN m USING (event_type) WHERE fold = 1
  UNION ALL SELECT ev.event_type, 'base', value, shift FROM ev JOIN base USING (grp, event_type) WHERE fold = 1
  UNION ALL SELECT event_type, 'base_mean', value, p FROM ev JOIN bm USING (event_type) WHERE fold = 1)
SELECT event_type, baseline, round(avg(abs(p - value)), 6) AS mae, count(*) AS n FROM rows GROUP BY 1, 2"""
)
def baselines(t: Tables) -> DataFrame:
    e = folded(t).withColumn("grp", (F.col("user_id") % 3).cast("string"))
    train = e.where("fold <> 1").groupBy("event_type").agg(F.avg("value").alias("mean"))
    base = t.spark.createDataFrame(BASE, "grp string, event_type string, shift double")
    return r6(M.baselines(e.where("fold = 1").select("event_type", "grp", "value"), train, base, "event_type", "value", "grp"), "mae")


@query(
    f"""WITH {PRED}, m AS (SELECT event_type, avg(y) c FROM preds GROUP BY 1),
per AS (SELECT event_type, event_type IN ('click', 'view') AS is_main, avg(abs(p - y)) AS mae, avg(abs(c - y)) AS b FROM preds JOIN m USING (event_type) GROUP BY 1)
SELECT is_main, round(avg(mae), 6) AS mae, round(avg(b), 6) AS baseline_mae, count(*) AS n_types, round((avg(b) - avg(mae)) * 100.0 / avg(b), 6) AS improvement FROM per GROUP BY 1"""
)
def macro_summary(t: Tables) -> DataFrame:
    p = predictions(t)
    m = p.groupBy("event_type").agg(F.avg("y").alias("c"))
    per = p.join(m, "event_type").groupBy("event_type").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(F.abs(F.col("c") - F.col("y"))).alias("baseline_mae"))
    return r6(M.macro_summary(per.withColumn("is_main", F.col("event_type").isin("click", "view")), "is_main"), "mae", "baseline_mae", "improvement")


@query(f"WITH {PRED}, s AS (SELECT event_type, greatest(stddev_samp(value), 0.1) s FROM events GROUP BY 1), per AS (SELECT event_type, avg(abs((p - y) / s)) m FROM preds JOIN s USING (event_type) WHERE event_type IN ('click', 'view', 'error') GROUP BY 1) SELECT round(avg(m), 6) AS z_mae, count(*) AS n_types FROM per")
def z_mae(t: Tables) -> DataFrame:
    st = stats.norm_stats(t.events, "event_type", "value").select(F.col("col").alias("event_type"), "std")
    p = predictions(t).join(st, "event_type").where(F.col("event_type").isin("click", "view", "error")).withColumn("ze", (F.col("p") - F.col("y")) / F.col("std"))
    return r6(M.z_mae(p, "event_type", "ze"), "z_mae")


HUBER = "CASE WHEN abs({e}) <= 0.5 THEN 0.5 * ({e}) * ({e}) ELSE 0.5 * (abs({e}) - 0.25) END"


@query(f"WITH {PRED} SELECT round(avg({HUBER.format(e='p - y')} * CASE WHEN event_type IN ('click', 'view') THEN 2.0 ELSE 1.0 END), 6) AS loss, count(*) AS n FROM preds")
def huber(t: Tables) -> DataFrame:
    return r6(M.huber(predictions(t), "y", "p", F.when(F.col("event_type").isin("click", "view"), 2.0).otherwise(1.0)), "loss")


DAYS = "cells AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_type, min(value) AS y, max(value) AS p FROM events GROUP BY 1, 2, 3)"


def cells(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day", "event_type").agg(F.min("value").alias("y"), F.max("value").alias("p"))


@query(
    f"""WITH {DAYS}, w AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'error') THEN 1.0 / count(*) OVER (PARTITION BY user_id, day, event_type IN ('click', 'view', 'error')) ELSE 1.0 END AS weight,
  CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' END AS other FROM cells),
l AS (SELECT weight, CASE WHEN m.y IS NULL THEN {HUBER.format(e='w.p - w.y')}
  ELSE 0.5 * least({HUBER.format(e='w.p - w.y')} + {HUBER.format(e='m.p - m.y')}, {HUBER.format(e='w.p - m.y')} + {HUBER.format(e='m.p - w.y')}) END AS loss
  FROM w LEFT JOIN cells m ON m.user_id = w.user_id AND m.day = w.day AND m.event_type = w.other)
SELECT round(avg(loss * weight), 6) AS loss, count(*) AS n FROM l"""
)
def swap_huber(t: Tables) -> DataFrame:
    groups = t.spark.createDataFrame([("click", "a"), ("view", "a"), ("error", "a")], "event_type string, grp string")
    pairs = t.spark.createDataFrame([("click", "view")], "event_type string, other string")
    return r6(M.swap_huber(cells(t), ["user_id", "day"], "event_type", "y", "p", groups, pairs), "loss")


@query(
    f"WITH {PRED}, e AS (SELECT round(p - y, 9) AS e FROM preds), h AS (SELECT CAST(least(floor((e + 100) / 4.0), 49) AS INTEGER) AS bin, count(*) AS n FROM e WHERE e BETWEEN -100 AND 100 GROUP BY 1) SELECT bin, n, round(n / (sum(n) OVER () * 4.0), 9) AS density FROM h"
)
def error_histogram(t: Tables) -> DataFrame:
    """Errors to 9 digits: the last bits of a mean follow the order of its sum, and errors on a bin's edge would fall to either side."""
    p = predictions(t).withColumn("e", F.round(F.col("p") - F.col("y"), 9))
    return M.error_histogram(p, "e", -100.0, 100.0).withColumn("density", F.round("density", 9))


@query(f"WITH {PRED} SELECT CAST(q AS DOUBLE) AS q, round((SELECT quantile_cont(abs(p - y), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) FROM preds)[i], 6) AS value FROM (VALUES (1, 0.1), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.9), (6, 0.95), (7, 0.99)) v(i, q)")
def percentile_ladder(t: Tables) -> DataFrame:
    return r6(M.percentile_ladder(predictions(t).withColumn("e", F.col("p") - F.col("y")), "e"), "value")


@query(f"WITH {PRED} SELECT event_type, round(corr(y, p), 6) AS r, count(*) AS n FROM preds GROUP BY 1")
def correlation(t: Tables) -> DataFrame:
    return r6(M.correlation(predictions(t), "y", "p", ["event_type"]), "r")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 6")
def top_types(t: Tables) -> DataFrame:
    return M.top_types(t.events, "user_id", 6)


@query("WITH d AS (SELECT user_id, event_id, value FROM events) SELECT user_id, arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best, round(avg(value), 6) AS mean_seconds FROM d GROUP BY 1")
def best_run(t: Tables) -> DataFrame:
    return r6(M.best_run(t.events.withColumn("seconds", F.col("value")), "user_id", "event_id", "value", "seconds"), "mean_seconds")


@query(
    f"""WITH {PRED}, a AS (SELECT event_type, avg(abs(p - y)) AS a FROM preds GROUP BY 1), b AS (SELECT event_type, avg(abs(c - y)) AS b FROM preds JOIN (SELECT event_type, avg(y) c FROM preds GROUP BY 1) USING (event_type) GROUP BY 1)
SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, round((b - a) * 100.0 / a, 6) AS percent FROM a JOIN b USING (event_type)"""
)
def model_delta(t: Tables) -> DataFrame:
    p = predictions(t)
    mean = p.groupBy("event_type").agg(F.avg("y").alias("c"))
    a, b = M.metrics(p, "y", "p", ["event_type"]), M.metrics(p.join(mean, "event_type"), "y", "c", ["event_type"])
    return r6(M.model_delta(a, b, "event_type"), "a", "b", "delta", "percent")


@query("SELECT user_id, round(max(value) FILTER (event_type = 'click'), 3) AS click, round(max(value) FILTER (event_type = 'view'), 3) AS \"view\" FROM events GROUP BY 1")
def prediction_table(t: Tables) -> DataFrame:
    return M.prediction_table(t.events, ["user_id"], "event_type", "value", ["click", "view"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def prediction_summary(t: Tables) -> DataFrame:
    return r6(M.prediction_summary(t.events, "event_type", "value"), "mean", "std")


@query(f"WITH {EV_FOLD} SELECT CASE WHEN fold = 2 THEN 'test' ELSE 'train' END AS part, fold, count(*) AS n FROM events_f GROUP BY 1, 2")
def loo_split_counts(t: Tables) -> DataFrame:
    return loo_split(folded(t), "fold", 2).groupBy("part", "fold").agg(F.count("*").alias("n"))


@query(
    f"""WITH {BASE_SQL}, al(event_type, alias, rank) AS (VALUES ('error', 'click', 1), ('error', 'view', 2), ('purchase', 'view', 1)),
ev AS (SELECT event_id, event_type, CAST(user_id % 4 AS VARCHAR) AS grp FROM events)
SELECT event_id, coalesce((SELECT shift FROM base b WHERE b.grp = ev.grp AND b.event_type = ev.event_type),
  (SELECT arg_min(shift, rank) FROM base b JOIN al ON al.alias = b.event_type WHERE b.grp = ev.grp AND al.event_type = ev.event_type)) AS center FROM ev"""
)
def coalesce_lookup(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", (F.col("user_id") % 4).cast("string").alias("grp"))
    table = t.spark.createDataFrame(BASE, "grp string, event_type string, center double")
    aliases = t.spark.createDataFrame([("error", "click", 1), ("error", "view", 2), ("purchase", "view", 1)], "event_type string, alias string, rank int")
    return stats.lookup_first(e, table, "grp", "event_type", ["center"], aliases).select("event_id", "center")


@query(
    f"""WITH {BASE_SQL}, ev AS (SELECT event_id, event_type, value, CAST(user_id % 3 AS VARCHAR) AS s, CAST((user_id + 1) % 3 AS VARCHAR) AS q FROM events)
SELECT event_id, round(coalesce(b2.shift + (value - b1.shift), value), 6) AS corrected FROM ev LEFT JOIN base b1 ON b1.grp = s AND b1.event_type = ev.event_type LEFT JOIN base b2 ON b2.grp = q AND b2.event_type = ev.event_type"""
)
def transfer_correction(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", "value", (F.col("user_id") % 3).cast("string").alias("s"), ((F.col("user_id") + 1) % 3).cast("string").alias("q"))
    base = t.spark.createDataFrame(BASE, "residue string, atom string, shift double")
    return r6(stats.transfer_correct(e, base, "s", "q", "event_type", "value").select("event_id", "corrected"), "corrected")


@query(f"SELECT doc_id, {fold_sql('CAST(doc_id AS VARCHAR)')} AS fold, {fold_sql(chr(39) + 'comp_' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} AS fold_comp FROM documents")
def md5_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.md5_fold(F.col("doc_id"), 5).alias("fold"), X.md5_fold(F.col("doc_id"), 5, "comp_").alias("fold_comp"))


@query(
    """SELECT event_id, round(sin(radians(value)), 6) AS s, round(cos(radians(value)), 6) AS c, round(greatest(-5.0, least(10.0, value / 10)), 6) AS clipped,
  round(value / 15.0, 6) AS near, round(ln(1 + abs(CAST(user_id - 75 AS DOUBLE))) / 5.0, 6) AS sep FROM events"""
)
def angle_features(t: Tables) -> DataFrame:
    s, c = X.angle_features(F.col("value"))
    near, sep = X.neighbour_features(F.col("value"), F.col("user_id") - 75)
    return r6(t.events.select("event_id", s.alias("s"), c.alias("c"), X.scale_clip(F.col("value"), 10.0, -5.0, 10.0).alias("clipped"), near.alias("near"), sep.alias("sep")), "s", "c", "clipped", "near", "sep")


@query("SELECT l_shipmode_code, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_shipmode_code FROM lineitem) GROUP BY 1")
def vocab_encode(t: Tables) -> DataFrame:
    return t.lineitem.select(X.code_of(F.col("l_returnflag"), ["A", "N"]).alias("l_shipmode_code")).groupBy("l_shipmode_code").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS a, CAST(l_returnflag = 'N' AS INTEGER) AS n, CAST(l_returnflag = 'R' AS INTEGER) AS r FROM lineitem")
def one_hot(t: Tables) -> DataFrame:
    v = X.one_hot(F.col("l_returnflag"), ["A", "N", "R"])
    return t.lineitem.select("l_orderkey", "l_linenumber", v[0].alias("a"), v[1].alias("n"), v[2].alias("r"))


@query(
    """WITH w AS (SELECT user_id, max(value) FILTER (event_type = 'click') a, max(value) FILTER (event_type = 'view') b, max(value) FILTER (event_type = 'error') c, min(event_type) k FROM events GROUP BY 1),
v AS (SELECT user_id, [coalesce(a, 0), coalesce(b, 0), coalesce(sin(radians(c)), 0), coalesce(cos(radians(c)), 0), CAST(k = 'click' AS INTEGER), CAST(k = 'error' AS INTEGER)] AS v FROM w)
SELECT user_id, CAST(i - 1 AS INTEGER) AS i, round(v[i], 6) AS x FROM v, range(1, 7) r(i)"""
)
def struct_vector(t: Tables) -> DataFrame:
    top = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    w = t.events.groupBy("user_id").agg(top("click").alias("a"), top("view").alias("b"), top("error").alias("c"), F.min("event_type").alias("k"))
    v = X.struct_vector([F.col("a")], [F.col("b")], [F.col("c")], [], F.col("k"), ["click", "error"])
    return r6(w.select("user_id", F.posexplode(v).alias("i", "x")), "x")


@query("SELECT event_id, 0.0::DOUBLE AS value, user_id FROM events")
def ablate(t: Tables) -> DataFrame:
    return X.ablate(t.events.select("event_id", "value", "user_id"), {"measure": ["value"], "who": ["user_id"]}, ["measure"])


@query("WITH c AS (SELECT user_id, count(*) n FROM events WHERE event_type = 'click' GROUP BY 1) SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS most, round(avg(CAST(n >= 20 AS INTEGER)), 6) AS at_cap FROM c")
def cap_stats(t: Tables) -> DataFrame:
    c = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return r6(M.cap_stats(c, "n", 20), "mean", "at_cap")
