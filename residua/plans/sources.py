"""Sources on data derived from the given tables: nested documents, fixed-width text, paths, landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.plans.geometry import ATOMS, residues
from residua.plans.registry import Tables, query
from residua.scratch import scratch_dir
from residua.sources import entries, files, structures
from residua.streaming.ingest import current_entries
from residua.streaming.ingest import incremental_ingest as ingest
from residua.streaming.ingest import ingest_entries as take_entries


#: An entry covers so many values of the event's id, so no entry grows with the table.
ENTRY_EVENTS = 1000


def entry_documents(t: Tables) -> DataFrame:
    """Each user's events as nested entries, one for a range of events: under the user's id, under ``data``, or under another name, by turns."""
    cell = F.array(
        F.when(F.col("event_id") % 11 == 0, ".").otherwise((F.col("event_id") % 1000).cast("string")),
        F.initcap("event_type"),
        F.lit("ca"),
        F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")),
        F.when(F.col("event_id") % 17 == 0, "bad").when(F.col("event_id") % 5 == 0, ".").otherwise("1"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", cell.alias("c")))), lambda z: z["c"])
    tags = F.array(*[F.lit(f"Atom_chem_shift.{x}") for x in ("Seq_ID", "Comp_ID", "Atom_ID", "Val", "Ambiguity_code")])
    frame = F.struct(F.array(F.struct(F.array(F.struct(tags.alias("tags"), F.col("rows").alias("data"))).alias("loops"))).alias("saveframes"))
    name = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("user_id") % 3 == 1, "data").otherwise("other")
    return t.events.groupBy("user_id", F.floor(F.col("event_id") / ENTRY_EVENTS)).agg(rows.alias("rows")).select("user_id", F.to_json(F.create_map(name, frame)).alias("doc"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS id, CAST(event_id % 1000 AS INTEGER) AS residue_id, upper(event_type) AS residue_code, 'CA' AS atom_id, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 END AS ambiguity_code
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"""
)
def entry_json(t: Tables) -> DataFrame:
    return entries.explode_entries(entry_documents(t), "user_id", "doc").drop("ord")


@query("SELECT CAST(user_id AS VARCHAR) AS id, 'P' || CAST(min(event_id) FILTER (event_type = 'click' AND event_id % 3 <> 0) AS VARCHAR) AS accession FROM events GROUP BY 1 HAVING min(event_id) FILTER (event_type = 'click' AND event_id % 3 <> 0) IS NOT NULL")
def first_match(t: Tables) -> DataFrame:
    cell = F.array(F.when(F.col("event_type") == "click", " unp ").otherwise(F.col("event_type")), F.when(F.col("event_id") % 3 == 0, ".").otherwise(F.concat(F.lit("P"), F.col("event_id").cast("string"))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", cell.alias("c")))), lambda z: z["c"])
    tags = F.array(F.lit("Entity_db_link.Database_code"), F.lit("Entity_db_link.Accession_code"))
    docs = t.events.groupBy("user_id").agg(rows.alias("rows"))
    frame = F.struct(F.array(F.struct(F.array(F.struct(tags.alias("tags"), F.col("rows").alias("data"))).alias("loops"))).alias("saveframes"))
    docs = docs.select("user_id", F.to_json(F.create_map(F.col("user_id").cast("string"), frame)).alias("doc"))
    return entries.extract_db_link(docs, "user_id", "doc")


#: A list of excluded ids covers so many values of the id.
LIST_IDS = 1000


def exclusion_lists(t: Tables) -> DataFrame:
    """Bare lists of the toxic documents, named lists of those of low quality; each of a range of ids."""
    ids = F.collect_set(F.col("doc_id").cast("string"))
    part = F.floor(F.col("doc_id") / LIST_IDS).alias("part")
    bare = t.labels.where("toxic = 1").groupBy(part).agg(F.to_json(ids).alias("doc"))
    named = t.labels.where("quality = 0").groupBy(part).agg(F.to_json(F.struct(ids.alias("bmrbs"))).alias("doc"))
    return bare.unionByName(named).select("doc")


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1 OR quality = 0")
def load_exclusions(t: Tables) -> DataFrame:
    return entries.load_exclusions(exclusion_lists(t), "doc")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, upper(x) AS item FROM part, unnest(string_split(p_name, ' ')) u(x) WHERE trim(x) <> ''")
def pairs_explode(t: Tables) -> DataFrame:
    return files.explode_pairs(t.part, "p_partkey", "p_name", " ")


@query(r"WITH b AS (SELECT string_split(url, '/')[-1] AS b FROM pages) SELECT DISTINCT regexp_extract(b, '^([0-9]+)(\.html)?', 1) AS key, regexp_extract(b, '^([0-9]+)(\.html)?', 2) AS suffix FROM b WHERE regexp_matches(b, '^([0-9]+)(\.html)?')")
def keys_from_path(t: Tables) -> DataFrame:
    return files.keys_from_paths(t.pages, "url", r"^([0-9]+)(\.html)?", ["key", "suffix"])


#: Positions of a file; numbers in files have four or five columns, and a file's text is one cell.
FILE_POSITIONS = 500


def _file(label: str, pos: str) -> Column:
    """(label, part): the file that holds a label's position, numbered from 1 in it."""
    return F.named_struct(F.lit("label"), F.col(label), F.lit("part"), F.floor(F.col(pos) / FILE_POSITIONS))


def _number(pos: str) -> Column:
    return F.pmod(F.col(pos), F.lit(FILE_POSITIONS)) + 1


def _whole(rows: DataFrame, number: str | None = "res_id") -> DataFrame:
    """``label`` in place of ``file``, and the number in the file made the position again."""
    if number is not None:
        rows = rows.withColumn(number, (F.col("file.part") * FILE_POSITIONS + F.col(number) - 1).cast("int"))
    return rows.select("file.label", *[c for c in rows.columns if c != "file"])


def structure_files(t: Tables) -> DataFrame:
    """(file, text): each label's residues as fixed-width lines in two models; the second one is shifted."""
    atoms = residues(t).select(_file("label", "pos").alias("file"), "label", _number("pos").alias("pos"), F.posexplode("atoms").alias("i", "a"))
    line = lambda dx: F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("i"), F.col("a.atom"), F.lit("ALA"), F.char(F.lit(65) + F.col("label")), F.col("pos"), F.col("a.x") + dx, F.col("a.y"), F.col("a.z"), F.lit(1.0), F.col("a.x") * 10)
    body = lambda dx: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", line(dx).alias("l")))), lambda z: z["l"]), "\n")
    both = atoms.groupBy("file").agg(body(0.0).alias("m1"), body(1.0).alias("m2"))
    return both.select("file", F.concat_ws("\n", F.lit("MODEL        1"), "m1", F.lit("ENDMDL"), F.lit("MODEL        2"), "m2", F.lit("ENDMDL"), F.lit("END")).alias("text"))


COORD = "CAST(printf('%.3f', {c}) AS DOUBLE)"


@query(f"WITH {ATOMS} SELECT label, CAST(1 AS INTEGER) AS model, chr(65 + label) AS chain, CAST(vec_id AS INTEGER) AS res_id, 'ALA' AS res_name, atom, {', '.join(COORD.format(c=c) + ' AS ' + c for c in 'xyz')} FROM atoms")
def atoms_fixed_width(t: Tables) -> DataFrame:
    return _whole(structures.read_atoms(structure_files(t), "file"))


@query("SELECT label, CAST(m AS INTEGER) AS model, chr(65 + label) AS chain, count(*) * 21 AS n FROM embeddings, range(1, 3) r(m) GROUP BY 1, 2, 3")
def atoms_all_models(t: Tables) -> DataFrame:
    return _whole(structures.read_atoms(structure_files(t), "file", first_model=False)).groupBy("label", "model", "chain").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT label, chr(65 + label) AS chain FROM embeddings")
def distinct_keys(t: Tables) -> DataFrame:
    return _whole(structures.list_chains(structure_files(t), "file"), None).distinct()


@query("SELECT label, chr(65 + label) AS chain, CAST(vec_id AS INTEGER) AS res_id, CAST(printf('%.2f', CAST(embedding[4] AS DOUBLE) * 10) AS DOUBLE) AS b_factor FROM embeddings")
def ca_bfactors(t: Tables) -> DataFrame:
    return _whole(structures.ca_bfactors(structure_files(t), "file"))


@query(
    """WITH v AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 1000 AS phi, CAST(embedding[2] AS DOUBLE) * 1000 AS psi, CAST(abs(embedding[3]) * 500 AS INTEGER) AS acc FROM embeddings)
SELECT label, chr(65 + label) AS chain, CAST(vec_id AS INTEGER) AS res_id, CASE WHEN vec_id % 3 = 0 THEN 'A' ELSE 'x' END AS aa, CASE WHEN vec_id % 4 = 0 THEN 'C' ELSE 'H' END AS ss,
  CASE WHEN abs(CAST(printf('%.1f', phi) AS DOUBLE)) <= 180 THEN CAST(printf('%.1f', phi) AS DOUBLE) END AS phi, CASE WHEN abs(CAST(printf('%.1f', psi) AS DOUBLE)) <= 180 THEN CAST(printf('%.1f', psi) AS DOUBLE) END AS psi,
  round(least(acc / CASE WHEN vec_id % 3 = 0 THEN 129.0 ELSE 200.0 END, 1.0), 6) AS rel_acc, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE -3 END AS nh_o_1_relidx, CAST(CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE -1.5 END AS DOUBLE) AS nh_o_1_energy FROM v WHERE vec_id % 10 <> 9"""
)
def fixed_width_defaults(t: Tables) -> DataFrame:
    e = F.col("embedding")
    n = F.col("vec_id")
    # 0-based columns: 5 number, 11 chain, 13 residue, 16 class, 34 area, 39 to 82 four bonds, 103 and 109 angles
    bond = F.when(n % 5 == 0, F.rpad(F.lit("    x, y"), 11, " ")).otherwise(F.rpad(F.lit("    -3,-1.5"), 11, " "))
    line = F.concat(
        F.lpad(_number("vec_id").cast("string"), 5, " "), F.lpad(_number("vec_id").cast("string"), 5, " "), F.lit(" "), F.char(F.lit(65) + F.col("label")), F.lit(" "),
        F.when(n % 10 == 9, "!").when(n % 3 == 0, "A").otherwise("x"), F.lit("  "), F.when(n % 4 == 0, " ").otherwise("H"), F.rpad(F.lit(""), 17, " "),
        F.lpad(F.round(F.abs(e[2].cast("double").cast("float")) * 500, 0).cast("int").cast("string"), 4, " "), F.lit(" "), bond, F.rpad(F.lit("     0, 0.0"), 53, " "),
        F.format_string("%6.1f%6.1f", e[0].cast("double") * 1000, e[1].cast("double") * 1000), F.rpad(F.lit(""), 20, " "),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, line.alias("l")))), lambda z: z["l"]), "\n")
    reports = t.embeddings.groupBy(_file("label", "vec_id").alias("file")).agg(F.concat(F.lit("==== report\n  #  RESIDUE AA STRUCTURE\n"), body).alias("text"))
    out = _whole(structures.read_ss_report(reports, "file"))
    return out.select("label", "chain", "res_id", "aa", "ss", "phi", "psi", F.round("rel_acc", 6).alias("rel_acc"), "nh_o_1_relidx", "nh_o_1_energy")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_new, CAST(0 AS BIGINT) AS n_corrupt FROM (SELECT count(*) AS n FROM events)")
def incremental_ingest(t: Tables) -> DataFrame:
    """Events landed as JSON in two goes; each call takes what is new, and the audit counts every row once."""
    at = f"{scratch_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    kind = "event_id long, user_id long, value double"
    rows = t.events.select("event_id", "user_id", "value")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").json(f"{at}/landed")
        audit = ingest(t.spark, f"{at}/landed", f"{at}/table", f"{at}/checkpoint", kind)
    return audit.agg(F.sum("n_new").alias("n_new"), F.sum("n_corrupt").alias("n_corrupt"))


@query(
    """WITH r AS (SELECT user_id AS i FROM events GROUP BY 1),
l AS (SELECT 1 AS n, i, i % 3 = 0 AS bad, 0 AS twist FROM r UNION ALL SELECT 2, i, i % 7 = 0, CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END FROM r UNION ALL SELECT 3, i, false, CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END FROM r),
g AS (SELECT *, CASE WHEN NOT bad THEN twist END AS digest FROM l),
s AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY i ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, coalesce(lag(bad) OVER (PARTITION BY i ORDER BY n), false) AS broken FROM g)
SELECT CASE WHEN bad THEN 'corrupt' WHEN before IS NULL THEN CASE WHEN broken THEN 'redone' ELSE 'new' END WHEN before = digest THEN 'same' WHEN broken THEN 'redone' ELSE 'changed' END AS status, count(*) AS n,
  (SELECT count(*) FROM r) AS n_current, (SELECT count(*) FROM events) AS n_events FROM s GROUP BY 1"""
)
def ingest_entries(t: Tables) -> DataFrame:
    """Each user's events as an entry that lands three times in two calls, broken at first for some and changed later for others: what each landing was, how many entries there are now,
    and how many events their last versions hold."""
    at = f"{scratch_dir(t.spark)}/entries-{uuid.uuid4().hex}"
    rows = t.events.groupBy(F.col("user_id").alias("i")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    i = F.col("i")
    doc = lambda bad, twist: F.when(bad, F.lit('{"n": ')).otherwise(F.to_json(F.struct("n", "total", twist.alias("twist"))))
    twist = F.when(i % 4 == 3, 1).otherwise(0)
    goes = [doc(i % 3 == 0, F.lit(0)), doc(i % 7 == 0, twist), doc(F.lit(False), twist)]
    landed = [rows.select(i.cast("string").alias("entry"), d.alias("doc"), F.lit(n).cast("long").alias("reached")) for n, d in enumerate(goes)]
    landed[0].write.json(f"{at}/landed")
    take_entries(t.spark, f"{at}/landed", f"{at}/table", f"{at}/checkpoint")
    landed[1].unionByName(landed[2]).write.mode("append").json(f"{at}/landed")
    landings = take_entries(t.spark, f"{at}/landed", f"{at}/table", f"{at}/checkpoint")
    now = current_entries(landings).agg(F.count("*").alias("n_current"), F.sum(F.get_json_object("doc", "$.n").cast("long")).alias("n_events"))
    return landings.groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(now))
