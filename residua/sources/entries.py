"""Nested entry documents: loops of tagged rows to long observations and database links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import constants as C

LOOPS = "array<struct<loops:array<struct<tags:array<string>,data:array<array<string>>>>>>"
_FRAME = f"struct<saveframes:{LOOPS}>"


def _entry(doc: Column, key: Column) -> Column:
    """The entry's saveframes: under its own key, else ``data``, else the first value that has any."""
    each = F.from_json(doc, f"map<string,{_FRAME}>")
    named = F.coalesce(F.try_element_at(each, key), F.try_element_at(each, F.lit("data")))
    rest = F.filter(F.map_values(each), lambda v: v["saveframes"].isNotNull())
    return F.coalesce(named["saveframes"], F.get(rest, F.lit(0))["saveframes"])


def loops(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, frame, loop, tags, data) of all loops in document order; tags lose their prefix up to the last dot."""
    key = F.col(id_col).cast("string")
    frames = docs.select(key.alias("id"), F.posexplode(_entry(F.col(json_col), key)).alias("frame", "f"))
    each = frames.select("id", "frame", F.posexplode("f.loops").alias("loop", "l"))
    return each.select("id", "frame", "loop", F.transform("l.tags", lambda t: F.substring_index(t, ".", -1)).alias("tags"), F.col("l.data").alias("data"))


def _cell(*tags: str) -> Column:
    """The row's value under the first tag of these that the loop has, the last one of equal tags."""
    place = lambda t: F.when(F.array_contains("tags", t), F.size("tags") - F.array_position(F.reverse("tags"), t))
    at = F.coalesce(*[place(t) for t in tags])
    return F.get(F.col("row"), at.cast("int"))


def explode_entries(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, residue_id, residue_code, atom_id, value, ambiguity_code, ord): one row for each observation.

    Loops need the tags Seq_ID, Comp_ID, Atom_ID and Val. Rows whose value or position is null, ``.`` or empty are left
    out, and so is every row with a number that does not parse; codes are upper-cased. Documents that are not JSON
    give nothing. ``ord`` is the place in the document.
    """
    need = [F.array_contains("tags", t) for t in ("Seq_ID", "Comp_ID", "Atom_ID", "Val")]
    rows = loops(docs, id_col, json_col).where(need[0] & need[1] & need[2] & need[3]).select("id", "frame", "loop", "tags", F.posexplode("data").alias("i", "row"))
    cells = rows.select("id", "frame", "loop", "i", *[_cell(t).alias(t) for t in ("Seq_ID", "Comp_ID", "Atom_ID", "Val", "Ambiguity_code")])
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", ".")
    code = F.when(known("Ambiguity_code"), F.col("Ambiguity_code"))
    out = cells.where(known("Val") & known("Seq_ID") & F.col("Comp_ID").isNotNull() & F.col("Atom_ID").isNotNull()).select(
        "id",
        F.col("Seq_ID").try_cast("int").alias("residue_id"),
        F.upper("Comp_ID").alias("residue_code"),
        F.upper("Atom_ID").alias("atom_id"),
        F.col("Val").try_cast("double").alias("value"),
        code.try_cast("int").alias("ambiguity_code"),
        (code.isNotNull() & code.try_cast("int").isNull()).alias("bad"),
        (F.col("frame") * F.lit(1 << 42) + F.col("loop") * F.lit(1 << 28) + F.col("i")).cast("long").alias("ord"),
    )
    return out.where("residue_id is not null and value is not null and not bad").drop("bad")


def extract_db_link(docs: DataFrame, id_col: str, json_col: str, names: list[str] | None = None) -> DataFrame:
    """(id, accession): the first row in document order whose database is one of the names and whose accession is known."""
    rows = loops(docs, id_col, json_col).select("id", "frame", "loop", "tags", F.posexplode("data").alias("i", "row"))
    cells = rows.select("id", F.struct("frame", "loop", "i").alias("ord"), F.upper(F.trim(_cell("Database_code", "database_code"))).alias("db"), F.trim(_cell("Accession_code", "accession_code", "Entry_code", "entry_code")).alias("accession"))
    ok = F.col("db").isin(C.PROTEIN_DATABASES if names is None else names) & ~F.col("accession").isin("", ".")
    return cells.where(ok).groupBy("id").agg(F.min_by("accession", "ord").alias("accession"))


def load_exclusions(docs: DataFrame, json_col: str, field: str = "bmrbs") -> DataFrame:
    """(id): a bare list, or the list under ``field``."""
    bare, named = F.from_json(json_col, "array<string>"), F.from_json(json_col, f"struct<{field}:array<string>>")[field]
    return docs.select(F.explode(F.coalesce(named, bare)).alias("id")).where("id is not null and id <> ''").distinct()
