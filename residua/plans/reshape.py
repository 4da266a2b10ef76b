"""Pivots, priority joins, unions and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import reshape, sequence
from residua.plans.registry import Tables, query


@query(
    """SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, arg_min(value, event_id) FILTER (event_type = 'click') AS click_value, arg_min(value, event_id) FILTER (event_type = 'view') AS view_value,
  arg_min(value, event_id) FILTER (event_type = 'nothing') AS nothing_value FROM events GROUP BY 1, 2"""
)
def pivot_first(t: Tables) -> DataFrame:
    return reshape.pivot_first(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", ["value"], ["click", "view", "nothing"], "event_id")


NATIONS = "c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)"


def nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return c, s


@query(f"WITH {NATIONS} SELECT *, 'hybrid' AS dataset FROM (SELECT * FROM c UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM c)) UNION ALL SELECT *, 'experimental' FROM c UNION ALL SELECT *, 'predicted' FROM s")
def hybrid_source(t: Tables) -> DataFrame:
    return reshape.choose_source(*nations(t), "k")


@query(f"WITH {NATIONS} SELECT k, arg_max(n, (p, n)) AS n FROM (SELECT *, 0 AS p FROM c UNION ALL SELECT *, 1 FROM s) GROUP BY 1")
def merge_maps(t: Tables) -> DataFrame:
    return reshape.merge_maps(list(nations(t)), "k", "n")


@query(f"WITH {NATIONS} SELECT k, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY 1")
def merge_sets(t: Tables) -> DataFrame:
    both = [d.select("k", F.col("n").cast("string").alias("n")) for d in nations(t)]
    return reshape.merge_maps(both, "k", "n", mode="union").withColumn("n", F.array_join("n", ","))


@query(f"WITH {NATIONS}, w AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) SELECT k, n FROM c WHERE k IN (SELECT k FROM w) UNION ALL SELECT k, n FROM s WHERE k IN (SELECT k FROM w) AND k NOT IN (SELECT k FROM c)")
def lookup_with_fallback(t: Tables) -> DataFrame:
    wanted = t.nation.select(F.col("n_nationkey").alias("k")).where("k < 15")
    return reshape.lookup_with_fallback(wanted, *nations(t), "k")


@query(
    """SELECT n_nationkey, (SELECT arg_min(path, (r, path)) FROM (SELECT CASE c_name WHEN 'Customer#' || lpad(CAST(n_nationkey * 70 AS VARCHAR), 9, '0') THEN 0 WHEN 'Customer#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') THEN 1 END AS r, c_mktsegment AS path FROM customer) WHERE r IS NOT NULL) AS path FROM nation"""
)
def priority_resolve(t: Tables) -> DataFrame:
    """The customer numbered 70 times the nation's key if there is one, else the one numbered as the nation."""
    names = [F.concat(F.lit("Customer#"), F.lpad((F.col("n_nationkey") * m).cast("string"), 9, "0")) for m in (70, 1)]
    listing = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("path"))
    return reshape.resolve_by_priority(t.nation.select("n_nationkey"), listing, "n_nationkey", names).select("n_nationkey", "path")


@query(
    """WITH r AS (SELECT CAST(s_nationkey AS VARCHAR) || ':' || CAST(s_suppkey % 2 AS VARCHAR) AS rk, min(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce((SELECT v FROM r WHERE rk = CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey % 3 AS VARCHAR)), (SELECT v FROM r WHERE rk = CAST(c_nationkey AS VARCHAR) || ':0'), (SELECT v FROM r WHERE rk = CAST(c_nationkey AS VARCHAR) || ':1')) AS v FROM customer"""
)
def fallback_join(t: Tables) -> DataFrame:
    right = t.supplier.groupBy(F.concat_ws(":", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 2).cast("string")).alias("rk")).agg(F.min("s_suppkey").alias("v"))
    left = t.customer.select("c_custkey", "c_nationkey")
    key = lambda x: F.concat_ws(":", F.col("c_nationkey").cast("string"), x)
    variants = [(key((F.col("c_custkey") % 3).cast("string")), "own"), (key(F.lit("0")), "even"), (key(F.lit("1")), "odd")]
    return reshape.fallback_join(left, right, variants, "rk", "v").select("c_custkey", "v")


@query("SELECT CAST(NULL AS BIGINT) AS l_orderkey, o_custkey, o_orderkey FROM orders UNION ALL SELECT l_orderkey, NULL, NULL FROM lineitem")
def union_uniform(t: Tables) -> DataFrame:
    return reshape.union_uniform([t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select("l_orderkey")])


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_orderkey k FROM orders UNION SELECT l_orderkey FROM lineitem) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT o_orderkey k FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'minus', count(*) FROM (SELECT o_orderkey k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)"""
)
def set_ops(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "minus": a.distinct().join(b, "k", "left_anti")}
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()])


@query("WITH o AS (SELECT conv_id, turn, min(upper(substr(role, 1, 1))) AS l FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(l, '' ORDER BY turn) AS seq FROM o GROUP BY 1 HAVING count(*) >= 4")
def sequence_build(t: Tables) -> DataFrame:
    return reshape.build_sequences(t.conversations, "conv_id", "turn", F.upper(F.substring("role", 1, 1)), least=4)


@query("WITH g AS (SELECT l_orderkey, l_suppkey, avg(l_quantity) q, count(*) n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_max(l_suppkey, (q, n, -l_suppkey)) AS l_suppkey, round(arg_max(q, (q, n, -l_suppkey)), 6) AS q, arg_max(n, (q, n, -l_suppkey)) AS n FROM g GROUP BY 1")
def best_candidate(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.avg("l_quantity").alias("q"), F.count("*").alias("n"))
    return reshape.best_candidate(g, "l_orderkey", ["q", "n"], "l_suppkey", "l_suppkey").withColumn("q", F.round("q", 6))


@query(
    """SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END::BIGINT AS n_rows, CASE WHEN l.doc_id IS NULL THEN 'empty' WHEN l.toxic = 1 THEN 'error: toxic' ELSE 'success' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def build_log(t: Tables) -> DataFrame:
    made = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("err"))
    return reshape.build_log(t.documents, made, "doc_id", "err")


def paired(t: Tables) -> DataFrame:
    """Each conversation's letters beside the next one's, both gapped by padding."""
    c = reshape.build_sequences(t.conversations, "conv_id", "turn", F.upper(F.substring("role", 1, 1)), least=1)
    other = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("seq").alias("seq_b"))
    both = c.join(other, "conv_id")
    n = F.greatest(F.length("seq"), F.length("seq_b"))
    return both.select("conv_id", "seq", "seq_b", F.rpad("seq", n, "-").alias("a"), F.lpad("seq_b", n, "-").alias("b"))


@query(
    """WITH o AS (SELECT conv_id, turn, min(upper(substr(role, 1, 1))) AS l FROM conversations GROUP BY 1, 2), q AS (SELECT conv_id, string_agg(l, '' ORDER BY turn) AS seq FROM o GROUP BY 1),
p AS (SELECT a.conv_id, rpad(a.seq, greatest(length(a.seq), length(b.seq))::INTEGER, '-') AS a, lpad(b.seq, greatest(length(a.seq), length(b.seq))::INTEGER, '-') AS b FROM q a JOIN q b ON b.conv_id = a.conv_id + 1),
c AS (SELECT conv_id, CAST(i - 1 AS INTEGER) AS col, substr(a, CAST(i AS INTEGER), 1) AS x, substr(b, CAST(i AS INTEGER), 1) AS y FROM p, range(1, 20) r(i) WHERE i <= length(a)),
n AS (SELECT *, sum(CAST(x <> '-' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY col) - 1 AS ia, sum(CAST(y <> '-' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY col) - 1 AS ib,
  sum(CAST(x <> '-' AS INTEGER)) OVER (PARTITION BY conv_id) AS na, sum(CAST(y <> '-' AS INTEGER)) OVER (PARTITION BY conv_id) AS nb FROM c)
SELECT conv_id, col, CASE WHEN x <> '-' THEN CAST(ia AS BIGINT) END AS index_a, CASE WHEN y <> '-' THEN CAST(ib AS BIGINT) END AS index_b,
  CASE WHEN x = '-' THEN 'gap_in_structure' WHEN y = '-' THEN 'gap_in_cs' WHEN x <> y THEN 'mismatch' WHEN ia < 2 OR ib < 2 OR ia >= na - 2 OR ib >= nb - 2 THEN 'protein_edge' ELSE 'match' END AS kind FROM n"""
)
def alignment_mapping(t: Tables) -> DataFrame:
    return sequence.alignment_mapping(paired(t), "conv_id", "a", "b")


SEQS = """o AS (SELECT conv_id, turn, min(upper(substr(role, 1, 1))) AS l FROM conversations GROUP BY 1, 2), q AS (SELECT conv_id, string_agg(l, '' ORDER BY turn) AS seq FROM o GROUP BY 1),
s AS (SELECT a.conv_id, a.seq AS a, b.seq AS b FROM q a JOIN q b ON b.conv_id = a.conv_id + 1)"""


@query(
    f"""WITH RECURSIVE {SEQS},
dp AS (SELECT conv_id, a, b, 0 AS i, [CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE -2.0 - 0.5 * (j - 1) END for j in range(length(b) + 1)] AS best, [-1e18::DOUBLE for j in range(length(b) + 1)] AS down,
  [CASE WHEN j = 0 THEN -1e18::DOUBLE ELSE -2.0 - 0.5 * (j - 1) END for j in range(length(b) + 1)] AS gap FROM s
UNION ALL SELECT conv_id, a, b, i + 1, [greatest(two[j + 1], gaps[j + 1]) for j in range(length(b) + 1)], one, gaps FROM (
  SELECT *, [coalesce(list_max([two[k + 1] - 2.0 - 0.5 * (j - k - 1) for k in range(j)]), -1e18) for j in range(length(b) + 1)] AS gaps FROM (
    SELECT *, [greatest(one[j + 1], CASE WHEN j = 0 THEN -1e18 ELSE best[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN 2.0 ELSE -1.0 END END) for j in range(length(b) + 1)] AS two FROM (
      SELECT *, [greatest(best[j + 1] - 2.0, down[j + 1] - 0.5) for j in range(length(b) + 1)] AS one FROM dp WHERE i < length(a))))),
tr AS (SELECT conv_id, a, b, length(a) AS i, length(b) AS k, 'best' AS mode, '' AS x, '' AS y FROM s
UNION ALL SELECT conv_id, a, b, i - CAST(go IN ('diagonal', 'down') AS INTEGER), k - CAST(go IN ('diagonal', 'right') AS INTEGER), CASE WHEN ends THEN 'best' ELSE go END,
  CASE WHEN go = 'right' THEN '-' ELSE substr(a, CAST(i AS INTEGER), 1) END || x, CASE WHEN go = 'down' THEN '-' ELSE substr(b, CAST(k AS INTEGER), 1) END || y FROM (
  SELECT *, go = 'diagonal' OR go = 'down' AND abs(down - above + 2.0) < 1e-9 OR go = 'right' AND abs(gap - before + 2.0) < 1e-9 AS ends FROM (
    SELECT t.*, c.down[k + 1] AS down, c.gap[k + 1] AS gap, c.best[k] AS before, p.best[k + 1] AS above,
      CASE WHEN mode <> 'best' THEN mode WHEN t.i > 0 AND k > 0 AND c.best[k + 1] = p.best[k] + CASE WHEN substr(t.a, CAST(t.i AS INTEGER), 1) = substr(t.b, CAST(k AS INTEGER), 1) THEN 2.0 ELSE -1.0 END THEN 'diagonal'
        WHEN t.i > 0 AND abs(c.best[k + 1] - c.down[k + 1]) < 1e-9 THEN 'down' ELSE 'right' END AS go
    FROM tr t JOIN dp c ON c.conv_id = t.conv_id AND c.i = t.i LEFT JOIN dp p ON p.conv_id = t.conv_id AND p.i = t.i - 1 WHERE t.i > 0 OR k > 0)))
SELECT d.conv_id, d.a AS seq, d.b AS seq_b, CAST(best[length(d.b) + 1] AS DOUBLE) AS score, x AS gapped_a, y AS gapped_b FROM dp d JOIN tr ON tr.conv_id = d.conv_id AND tr.i = 0 AND tr.k = 0 WHERE d.i = length(d.a)"""
)
def align_pairs(t: Tables) -> DataFrame:
    """The alignments with the tie rule, by dynamic programming and a walk back in SQL."""
    return sequence.align_pairs(paired(t).select("conv_id", "seq", "seq_b"), "seq", "seq_b")


@query(
    """WITH m AS (SELECT l_orderkey AS e, l_linenumber AS struct_id, CASE WHEN l_quantity < 25 THEN l_linenumber ELSE l_linenumber + 1 END AS target_id, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) k FROM lineitem) WHERE k = 1),
tg AS (SELECT l_orderkey AS e, l_linenumber AS target_id, min(l_returnflag) AS code FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), st AS (SELECT l_orderkey AS e, l_linenumber AS struct_id, max(l_returnflag) AS code FROM lineitem GROUP BY 1, 2)
SELECT m.e, m.struct_id AS pos, m.target_id, coalesce(tg.code, CASE WHEN st.code IN ('A', 'N') THEN st.code END, 'UNK') AS code FROM m JOIN tg ON tg.e = m.e AND tg.target_id = m.target_id LEFT JOIN st ON st.e = m.e AND st.struct_id = m.struct_id"""
)
def mapped_join(t: Tables) -> DataFrame:
    from residua.operators.quality import first_per_key

    one = first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    m = one.select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("struct_id"), F.when(F.col("l_quantity") < 25, F.col("l_linenumber")).otherwise(F.col("l_linenumber") + 1).alias("target_id"))
    keys = [F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("pos")]
    targets = t.lineitem.where("l_linestatus = 'O'").groupBy(*keys).agg(F.min("l_returnflag").alias("code"))
    structure = t.lineitem.groupBy(*keys).agg(F.max("l_returnflag").alias("code"))
    return reshape.mapped_join(m, targets, structure, "e", known=["A", "N"]).select("e", "pos", "target_id", "code")
