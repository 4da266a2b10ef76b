"""Vetoes, outliers, codes and masks on orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expressions as X
from residua.operators import position, quality
from residua.plans.measures import EV_FOLD, folded, r6
from residua.plans.registry import Tables, query


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) GROUP BY 1")
def entity_veto(t: Tables) -> DataFrame:
    bad = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
    return quality.drop_entities_with_any(t.orders, "o_custkey", bad).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 40)")
def id_subset(t: Tables) -> DataFrame:
    return quality.first_entities(t.orders, "o_custkey", 40).select("o_orderkey", "o_custkey")


@query(
    """WITH b AS (SELECT user_id, avg(value) m, stddev_samp(value) s, count(value) n FROM events GROUP BY 1)
SELECT event_id, CASE WHEN n >= 10 AND s >= 1e-6 AND (value < m - 2.5 * s OR value > m + 2.5 * s) THEN NULL ELSE value END AS value FROM events JOIN b USING (user_id)"""
)
def group_outliers(t: Tables) -> DataFrame:
    out, _ = quality.null_group_outliers(t.events.select("event_id", "user_id", "value"), ["value"], "user_id", k=2.5)
    return out.select("event_id", "value")


@query("WITH b AS (SELECT avg(value) m, stddev_samp(value) s FROM events) SELECT count(*) FILTER (value < m - 3 * s OR value > m + 3 * s) AS value FROM events, b")
def outlier_counts(t: Tables) -> DataFrame:
    return quality.null_group_outliers(t.events, ["value"], None, k=3.0)[1]


@query(
    f"""WITH {EV_FOLD}, b AS (SELECT event_type, avg(value) m, stddev_samp(value) s FROM events_f WHERE fold <> 1 GROUP BY 1 HAVING count(value) > 10 AND stddev_samp(value) > 1e-6)
SELECT event_id, CASE WHEN value < m - 2 * s OR value > m + 2 * s THEN NULL ELSE value END AS value FROM events_f LEFT JOIN b USING (event_type)"""
)
def bounds_outliers(t: Tables) -> DataFrame:
    train = folded(t).where("fold <> 1").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return quality.null_by_bounds(t.events.select("event_id", "event_type", "value"), train, "event_type", "value", k=2.0).select("event_id", "value")


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, (-n, l_returnflag)) AS l_returnflag FROM c GROUP BY 1, 2")
def mode_code(t: Tables) -> DataFrame:
    return quality.one_code_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, (-n, l_returnflag)) AS code FROM c GROUP BY 1, 2),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber ORDER BY CAST(l_returnflag = code AS INTEGER) DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem l JOIN m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM r WHERE k = 1"""
)
def prefer_match(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    chosen = quality.one_code_per_key(t.lineitem, keys, "l_returnflag")
    out = quality.prefer_matching_row(t.lineitem, chosen, keys, "l_returnflag", ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return out.select(*keys, "l_partkey", "l_suppkey", "l_returnflag")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE k = 1")
def dup_positions(t: Tables) -> DataFrame:
    return quality.first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH d AS (SELECT l_orderkey, l_linenumber, count(*) c FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) SELECT l_orderkey, count(*) AS n_keys, CAST(sum(c - 1) AS BIGINT) AS n_extra FROM d GROUP BY 1")
def duplicate_report(t: Tables) -> DataFrame:
    return quality.duplicate_report(t.lineitem, "l_orderkey", ["l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS n_codes FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def multi_code_audit(t: Tables) -> DataFrame:
    return quality.multi_code_audit(t.lineitem, ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("WITH g AS (SELECT l_orderkey, count(*) AS n_aligned, CAST(sum(CAST(l_returnflag = 'N' AS INTEGER)) AS DOUBLE) / count(*) AS identity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT l_orderkey, n_aligned, round(identity, 6) AS identity FROM g WHERE identity >= 0.8")
def identity_gate(t: Tables) -> DataFrame:
    return r6(quality.identity_gate(t.lineitem, "l_orderkey", F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"), "identity")


WIDE_SQL = "wide AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2)"


def wide(t: Tables) -> DataFrame:
    top = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(top("click").alias("click"), top("view").alias("view"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))


@query(f"WITH {WIDE_SQL} SELECT user_id, CAST(sum(CAST(click IS NOT NULL AND errors <= 1 AS INTEGER)) AS BIGINT) AS n_click, CAST(sum(CAST(view IS NOT NULL AND errors <= 1 AS INTEGER)) AS BIGINT) AS n_view FROM wide GROUP BY 1")
def loss_mask(t: Tables) -> DataFrame:
    w = wide(t).withColumn("status", F.when(F.col("errors") > 1, "mismatch").otherwise("match"))
    m = quality.loss_mask(w, ["click", "view"], ["click", "view"], "status", ["mismatch", "gap_in_structure"])
    return m.groupBy("user_id").agg(F.sum(F.col("click__mask").cast("int")).alias("n_click"), F.sum(F.col("view__mask").cast("int")).alias("n_view"))


@query(f"WITH {WIDE_SQL} SELECT user_id, count(*) AS n FROM wide WHERE click IS NOT NULL OR view IS NOT NULL GROUP BY 1")
def sample_index(t: Tables) -> DataFrame:
    return position.sample_index(wide(t), ["click", "view"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {WIDE_SQL}, d AS (SELECT *, date_diff('day', DATE '2024-01-01', day) AS pos FROM wide),
s AS (SELECT user_id, pos, 'click' AS nucleus, click AS target FROM d WHERE click IS NOT NULL UNION ALL SELECT user_id, pos, 'view', view FROM d WHERE view IS NOT NULL)
SELECT s.user_id, CAST(s.pos AS BIGINT) AS pos, s.nucleus, s.target, count(*) AS n_context, CAST(sum(CASE WHEN c.click IS NOT NULL AND NOT (c.pos = s.pos AND s.nucleus = 'click') THEN 1 ELSE 0 END) AS BIGINT) AS n_click,
  CAST(sum(CASE WHEN c.view IS NOT NULL AND NOT (c.pos = s.pos AND s.nucleus = 'view') THEN 1 ELSE 0 END) AS BIGINT) AS n_view
FROM s JOIN d c ON c.user_id = s.user_id AND c.pos BETWEEN s.pos - 5 AND s.pos + 5 GROUP BY 1, 2, 3, 4"""
)
def impute_samples(t: Tables) -> DataFrame:
    w = wide(t).withColumn("pos", F.datediff("day", F.lit("2024-01-01")).cast("long"))
    s = position.impute_samples(w, "user_id", "pos", ["click", "view"])
    seen = lambda c: F.size(F.filter("context", lambda z: z[c].isNotNull())).cast("long")
    return s.select("user_id", "pos", "nucleus", "target", F.size("context").cast("long").alias("n_context"), seen("click").alias("n_click"), seen("view").alias("n_view"))


@query("SELECT count(*) AS n_rows, CAST(sum(CAST(l.doc_id IS NULL AS INTEGER)) AS BIGINT) AS n_bad, bool_and(l.doc_id IS NOT NULL) AS stamped FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def provenance_gate(t: Tables) -> DataFrame:
    folds = t.labels.select("doc_id", X.md5_fold(F.col("doc_id"), 5).alias("fold"))
    stamped = quality.stamp_folds(t.documents.select("doc_id"), folds, "doc_id")
    return quality.provenance_summary(stamped, "provenance")


@query("SELECT sum(CAST(p_name LIKE '%red%' AS INTEGER))::BIGINT AS n_known, count(*) AS n FROM part")
def class_filter(t: Tables) -> DataFrame:
    code = F.when(F.col("p_name").contains("red"), "ala").otherwise("DA")
    return t.part.agg(F.sum(X.is_amino(code).cast("int")).alias("n_known"), F.count("*").alias("n"))
