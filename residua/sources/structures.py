"""Fixed-width structure files and secondary-structure reports, parsed with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.functions import constants as C


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _field(start: int, length: int) -> Column:
    return F.trim(F.substring("line", start, length))


def atom_lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, model, line_no, fields...) of ATOM and HETATM lines whose numbers parse and whose alternate is blank, A or 1.

    The model counts the MODEL lines so far (0 before the first, a file without any is one model); lines after an ENDMDL and before
    the next MODEL belong to no model. One window in each file, over its record lines only.
    """
    rows = files.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    kind = F.rtrim(F.substring("line", 1, 6))
    rows = rows.withColumn("kind", kind).where(F.col("kind").isin("ATOM", "HETATM", "ENDMDL") | F.col("kind").startswith("MODEL"))
    so_far = Window.partitionBy(key).orderBy("line_no")
    opens = F.col("kind").startswith("MODEL")
    rows = rows.withColumn("model", F.sum(opens.cast("int")).over(so_far))
    mark = F.last(F.when(opens | (F.col("kind") == "ENDMDL"), F.col("kind")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("closed", F.coalesce(mark == "ENDMDL", F.lit(False)))
    rows = rows.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM") & ~F.col("closed") & F.substring("line", 17, 1).isin(" ", "A", "1"))
    out = rows.select(
        key, "model", "line_no",
        (F.substring("line", 1, 4) == "ATOM").alias("is_atom"),
        _field(13, 4).alias("atom"), _field(18, 3).alias("res_name"), _field(22, 1).alias("chain"), _field(23, 4).try_cast("int").alias("res_id"),
        *[_field(31 + 8 * i, 8).try_cast("double").alias(c) for i, c in enumerate("xyz")],
        _field(61, 6).try_cast("double").alias("b_factor"),
    )
    return out.where("res_id is not null and x is not null and y is not null and z is not null")


def read_atoms(files: DataFrame, key: str, first_model: bool = True, chains: list[str] | None = None, text: str = "text") -> DataFrame:
    """(key, model, chain, res_id, res_name, atom, x, y, z): the last line of an atom stands, the first name of a residue.

    With ``first_model`` only the first model that has atoms; else all, numbered from 1 over those that have any. Chains
    None, or ``_`` among them, are all.
    """
    rows = atom_lines(files, key, text)
    if chains is not None and "_" not in chains:
        rows = rows.where(F.col("chain").isin(chains))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("model"))
    rows = rows.withColumn("model", number)
    if first_model:
        rows = rows.where("model = 1")
    residue = [key, "model", "chain", "res_id"]
    atoms = rows.groupBy(*residue, "atom").agg(F.max_by(F.struct("x", "y", "z"), "line_no").alias("p"), F.min(F.struct("line_no", "res_name")).alias("n"))
    name = F.min("n").over(Window.partitionBy(*residue))["res_name"]
    return atoms.select(*residue, name.alias("res_name"), "atom", "p.x", "p.y", "p.z")


def list_chains(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chain) of the first model's chains that have a name."""
    rows = atom_lines(files, key, text).select(key, "model", "chain").distinct()
    first = rows.groupBy(key).agg(F.min("model").alias("model"))
    return rows.join(first.hint("merge"), [key, "model"], "left_semi").where("chain <> ''").select(key, "chain").distinct()


def ca_bfactors(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chain, res_id, b_factor) of the CA atoms of the first model, ATOM lines only; the last line stands."""
    rows = atom_lines(files, key, text).where("is_atom and atom = 'CA' and b_factor is not null")
    first = rows.groupBy(key).agg(F.min("model").alias("model"))
    return rows.join(first.hint("merge"), [key, "model"], "left_semi").groupBy(key, "chain", "res_id").agg(F.max_by("b_factor", "line_no").alias("b_factor"))


#: Names and 0-based first columns of the four bonds of a report line, each index,energy in 11 characters.
BONDS = {"nh_o_1": 39, "o_nh_1": 50, "nh_o_2": 61, "o_nh_2": 72}


def read_ss_report(files: DataFrame, key: str, text: str = "text", max_area: dict[str, int] | None = None, default_area: int = 200) -> DataFrame:
    """(key, chain, res_id, aa, ss, phi, psi, rel_acc, bonds...) of the data lines of secondary-structure reports.

    Data begins after the header line with ``#  RESIDUE AA``; lines shorter than 120 and chain breaks are skipped, a
    blank class is C, angles beyond 180 are null, a bond that does not parse is (0, 0.0), relative area is at most 1.
    """
    areas = C.ACCESSIBLE_AREA if max_area is None else max_area
    lines = F.split(F.col(text), "\n")
    head = F.array_position(F.transform(lines, lambda x: x.contains("#  RESIDUE AA")), True)
    body = F.slice(lines, head.cast("int") + 1, F.size(lines))
    rows = files.select(key, F.when(head > 0, body).alias("b")).select(key, F.explode("b").alias("line")).where("length(line) >= 120 and substring(line, 14, 1) <> '!'")
    at = lambda a, b: F.trim(F.substring("line", a + 1, b - a))
    aa = F.substring("line", 14, 1)
    area = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in areas.items() for x in p]), aa), F.lit(default_area))
    ss = F.substring("line", 17, 1)
    angle = lambda a, b: F.when(F.abs(at(a, b).try_cast("double")) <= 180, at(a, b).try_cast("double"))
    bonds = []
    for name, a in BONDS.items():
        pair = F.split(F.substring("line", a + 1, 11), ",")
        i, e = F.trim(F.get(pair, F.lit(0))).try_cast("int"), F.trim(F.get(pair, F.lit(1))).try_cast("double")
        ok = i.isNotNull() & e.isNotNull()
        bonds += [F.when(ok, i).otherwise(0).alias(f"{name}_relidx"), F.when(ok, e).otherwise(0.0).alias(f"{name}_energy")]
    out = rows.select(
        key, F.substring("line", 12, 1).alias("chain"), at(5, 10).try_cast("int").alias("res_id"), aa.alias("aa"),
        F.when(ss == " ", "C").otherwise(ss).alias("ss"), angle(103, 109).alias("phi"), angle(109, 115).alias("psi"),
        F.least(at(34, 38).try_cast("double") / area, F.lit(1.0)).alias("rel_acc"), *bonds,
    )
    return out.where("res_id is not null and rel_acc is not null")
