"""Near-duplicate documents, components, exclusion, folds and leak checks on documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import quality, sequence, split
from residua.operators.components import connected_components
from residua.plans.measures import fold_sql
from residua.plans.registry import Tables, query


def duplicate_edges(t: Tables) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    tokens = F.filter(words, lambda w: w != "")
    return sequence.near_duplicates(t.documents.withColumn("tokens", tokens), "doc_id", F.col("tokens"), coverage=0.0)


PAIR_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] ELSE array_to_string(ws, ' ') END AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0),
sigs AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep FROM (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS sig FROM sh GROUP BY 1)),
rsh AS MATERIALIZED (SELECT sh.doc_id, s, n FROM sh JOIN sigs ON sh.doc_id = sigs.doc_id AND sigs.rep = sigs.doc_id),
edges AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS n_a, any_value(b.n) AS n_b FROM rsh a JOIN rsh b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY 1, 2 HAVING count(*) >= 0.9 * (any_value(a.n) + any_value(b.n) - count(*))
  UNION ALL SELECT rep, doc_id, n, n, n FROM sigs WHERE doc_id <> rep)"""
COMP_SQL = f"""WITH RECURSIVE {PAIR_SQL}, sym AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(id, b) AS (SELECT a, b FROM sym UNION SELECT r.id, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS MATERIALIZED (SELECT d.doc_id AS id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component FROM documents d LEFT JOIN reach r ON r.id = d.doc_id GROUP BY 1)"""


@query(f"WITH {PAIR_SQL} SELECT a, b, CAST(common AS INTEGER) AS common, CAST(n_a AS INTEGER) AS n_a, CAST(n_b AS INTEGER) AS n_b FROM edges")
def near_duplicates(t: Tables) -> DataFrame:
    return duplicate_edges(t)


def document_components(t: Tables) -> DataFrame:
    return connected_components(duplicate_edges(t), t.documents.select(F.col("doc_id").alias("id")), src="a", dst="b")


@query(f"{COMP_SQL} SELECT id, component FROM comp")
def components(t: Tables) -> DataFrame:
    return document_components(t)


@query(f"{COMP_SQL}, k AS (SELECT component, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS m FROM comp GROUP BY 1 HAVING count(*) > 1) SELECT a.id, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS others FROM comp a JOIN comp b ON a.component = b.component AND a.id <> b.id GROUP BY 1")
def exclusion_map(t: Tables) -> DataFrame:
    return split.exclusion_map(document_components(t)).select("id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


@query(f"{COMP_SQL} SELECT id, component, n - 1 AS n_others FROM (SELECT id, component, count(*) OVER (PARTITION BY component) AS n FROM comp) WHERE n > 1")
def exclusion_members(t: Tables) -> DataFrame:
    return split.exclusion_members(document_components(t))


#: Seeds: the documents that a toxic label marks. Holdout: every 25th document.
SEED_SQL = "seeds AS (SELECT doc_id AS id FROM labels WHERE toxic = 1), excl AS (SELECT id, component FROM comp WHERE component IN (SELECT component FROM comp WHERE id IN (SELECT id FROM seeds)))"
FOLD_SQL = f"""sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS k FROM comp),
folds AS (SELECT id, component, CASE WHEN id IN (SELECT id FROM excl) THEN 0 WHEN k > 1 THEN {fold_sql("'comp_' || CAST(component AS VARCHAR)")} ELSE {fold_sql("'doc_' || CAST(id AS VARCHAR)")} END AS fold,
  CASE WHEN id IN (SELECT id FROM excl) THEN 'excluded' WHEN k > 1 THEN 'component' ELSE 'single' END AS policy FROM sized)"""


def seeds(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))


def folds(t: Tables, comps: DataFrame) -> DataFrame:
    return split.assign_folds(comps, split.exclusion_propagation(comps, seeds(t)), single_prefix="doc_")


@query(f"{COMP_SQL}, {SEED_SQL} SELECT id, component FROM excl")
def exclusion_propagation(t: Tables) -> DataFrame:
    return split.exclusion_propagation(document_components(t), seeds(t))


@query(f"{COMP_SQL}, {SEED_SQL}, {FOLD_SQL} SELECT * FROM folds")
def assign_folds(t: Tables) -> DataFrame:
    return folds(t, document_components(t))


@query(
    f"""{COMP_SQL}, {SEED_SQL}, {FOLD_SQL}, listed AS (SELECT DISTINCT id FROM (SELECT item_id * 25 AS id FROM benchmark UNION ALL SELECT -1)),
hit AS (SELECT id FROM folds WHERE component IN (SELECT component FROM folds WHERE id IN (SELECT id FROM listed)) AND component IN (SELECT component FROM folds GROUP BY 1 HAVING count(*) > 1) UNION SELECT id FROM listed)
SELECT coalesce(f.id, h.id) AS id, coalesce(f.component, h.id) AS component, CASE WHEN h.id IS NOT NULL THEN 6 ELSE fold END AS fold, CASE WHEN h.id IS NOT NULL THEN 'holdout' ELSE policy END AS policy FROM folds f FULL JOIN hit h ON f.id = h.id"""
)
def holdout_force(t: Tables) -> DataFrame:
    listed = t.benchmark.select((F.col("item_id") * 25).alias("id")).unionByName(t.spark.createDataFrame([(-1,)], "id long"))
    return split.holdout_force(folds(t, document_components(t)), listed)


@query(f"{COMP_SQL}, {SEED_SQL}, {FOLD_SQL} SELECT fold, count(DISTINCT id) AS n_ids, count(*) AS n_rows FROM folds GROUP BY 1")
def fold_counts(t: Tables) -> DataFrame:
    return split.fold_counts(folds(t, document_components(t)), "fold", "id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped(t: Tables) -> DataFrame:
    return split.unmapped(t.documents, t.labels, "doc_id")


@query(
    f"""{COMP_SQL}, {SEED_SQL}, {FOLD_SQL}, used AS (SELECT f.*, d.source FROM folds f JOIN documents d ON d.doc_id = f.id WHERE fold > 0)
SELECT 'components' AS "check", count(*) AS n FROM (SELECT component FROM used GROUP BY 1 HAVING count(DISTINCT fold) > 1) UNION ALL
SELECT 'groups', count(*) FROM (SELECT source FROM used GROUP BY 1 HAVING count(DISTINCT fold) > 1) UNION ALL SELECT 'excluded', count(*) FROM used WHERE fold < 6 AND id IN (SELECT id FROM excl)"""
)
def leakage_report(t: Tables) -> DataFrame:
    comps = document_components(t)
    groups = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    return split.leakage_report(folds(t, comps), groups, split.exclusion_propagation(comps, seeds(t)))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def paired_exclusion(t: Tables) -> DataFrame:
    return split.paired_exclusion(t.lineitem, t.part.where("p_size = 7").select("p_partkey"), "l_orderkey", "l_partkey")


@query("SELECT doc_id, -1 AS fold, CAST(NULL AS VARCHAR) AS provenance FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 1, 'stamped' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def stamp_folds(t: Tables) -> DataFrame:
    return quality.stamp_folds(t.documents.select("doc_id"), t.labels.select("doc_id", F.lit(1).alias("fold")), "doc_id")
