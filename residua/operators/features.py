"""The one table that training and serving read: every feature of a residue, from the joined rows and the residues' atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import constants as C
from residua.functions.expressions import angle_features, code_of
from residua.operators import geometry, position
from residua.scratch import written

#: Rows of these kinds are no supervision: their structure is missing or another residue's.
CLEARED = ("gap_in_structure", "mismatch")


def _z(value: str, given: dict[str, tuple[float, float]], least_std: float = 1e-6, clip: float = 10.0) -> Column:
    """The clipped z value, value - mean where the spread is next to none, the value itself without statistics; 0 for null."""
    v = F.col(value).cast("double")
    if value in given:
        mean, std = given[value]
        v = (v - mean) / std if std > least_std else v - mean
    return F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), v)), F.lit(0.0))


def structure_features(residues: DataFrame, entity: str, pos: str, w: int = 5, k: int = 5, min_sep: int = 4, m: int = 400, cap: int = 600, heavy: float = 8.0, h: float = 6.0) -> DataFrame:
    """(entity, pos, pairs, cloud, neighbours, bonds, cross) from (entity, pos, atoms), unique positions: distances inside the residue, its side chain's
    summary, its nearest residues, the lengths to its neighbours in sequence and atom pairs to those around. Atoms are vocabulary codes."""
    keys = [entity, pos]
    atom = lambda a: code_of(a, C.ATOMS)
    one = lambda name: F.get(F.filter("atoms", lambda z: z["atom"] == name), F.lit(0))
    flat = residues.select(*keys, *[one(name)[c].alias(f"{name.lower()}_{c}") for name in ("CA", "C", "N") for c in "xyz"])
    # written, since the neighbours themselves and the pairs with them both read it
    near = written(geometry.spatial_knn(flat, entity, pos, ["ca_x", "ca_y", "ca_z"], k, min_sep).withColumnRenamed("pos", pos), "near")
    pairs = geometry.sparse_topm(geometry.intra_pairs(residues, keys), keys, m)
    pairs = pairs.select(*keys, F.transform("pairs", lambda z: F.struct(atom(z["a1"]).alias("a1"), atom(z["a2"]).alias("a2"), z["d"].alias("d"))).alias("pairs"))
    cloud = geometry.cloud_summary(residues, keys).select(*keys, F.struct("n", "mean", "spread", "most", "centroid").alias("cloud"))
    bonds = position.adjacent_geometry(flat, entity, pos).select(*keys, F.array(*[F.coalesce(F.col(c) / 10.0, F.lit(0.0)) for c in C.BOND_COLUMNS]).alias("bonds"))
    cross = geometry.cross_pairs(residues, near, entity, pos, w, cap, heavy, h, C.ATOMS)
    cross = cross.select(*keys, F.transform("pairs", lambda z: F.struct(atom(z["a1"]).alias("a1"), atom(z["a2"]).alias("a2"), F.greatest(F.lit(-5.0), F.least(F.lit(10.0), z["d"] / 10.0)).alias("d"), z["code"].alias("code"))).alias("cross"))
    spatial = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "neighbour", "dist", "seq_sep"))).alias("neighbours"))
    out = residues.select(*keys)
    for part in (pairs, cloud, spatial, bonds, cross):
        out = out.join(part.hint("merge"), keys, "left")
    return out


def residue_features(rows: DataFrame, residues: DataFrame, stats: DataFrame, entity: str, pos: str, targets: list[str], report: list[str], code: str = "code", ss: str = "ss", kind: str = "kind", **options) -> DataFrame:
    """All features of each row of ``rows``, the one function for training and for serving.

    ``rows`` has (entity, pos, code, ss, kind, phi, psi), the report's columns and the targets (none when serving); ``residues`` the atoms as arrays for unique (entity,
    pos); ``stats`` the statistics of the training side by ``norm_stats``, of which the global rows of the named columns, so at most as many numbers, are read
    here. Gives code_idx, ss_idx, kind_idx (unknown and null have a code of their own; a null class is C), report_z, target_z and target_mask in the
    order of their columns, angles (sine and cosine of phi and psi), window (the offsets and positions around that exist), and the columns
    of ``structure_features``. Null is 0 in every number. A target counts if it is observed, has statistics, and its row's kind is none of CLEARED.
    Repeated positions are all kept; windows and structure know a position once. Rows without structure have null arrays there.
    """
    wanted = stats.where("scope = 'global'").where(F.col("col").isin([*targets, *report])).select("col", "mean", "std")
    given = {r["col"]: (r["mean"], r["std"]) for r in wanted.collect()}
    clear = F.coalesce(F.col(kind).isin(*CLEARED), F.lit(False))
    numbers = lambda cols, one, t: F.array(*[one(c) for c in cols]) if cols else F.array().cast(f"array<{t}>")
    own = rows.select(
        entity,
        pos,
        code_of(F.upper(F.col(code)), C.RESIDUES).alias("code_idx"),
        code_of(F.coalesce(F.col(ss), F.lit("C")), C.STRUCTURE_CLASSES).alias("ss_idx"),
        code_of(F.col(kind), C.MAPPING_CLASSES).alias("kind_idx"),
        numbers(report, lambda c: _z(c, given), "double").alias("report_z"),
        numbers(targets, lambda c: _z(c, given) if c in given else F.lit(0.0), "double").alias("target_z"),
        numbers(targets, lambda c: F.col(c).isNotNull() & ~clear if c in given else F.lit(False), "boolean").alias("target_mask"),
        F.array(*angle_features(F.col("phi"), F.col("psi"))).alias("angles"),
    )
    w = options.get("w", 5)
    places = position.window_context(rows.select(entity, pos).distinct(), entity, pos, [], w)
    places = places.select(entity, pos, F.transform("context", lambda z: F.struct(z["offset"].alias("offset"), (z["offset"] + F.col(pos)).alias("pos"))).alias("window"))
    shape = structure_features(residues, entity, pos, **options)
    return own.join(places.hint("merge"), [entity, pos]).join(shape.hint("merge"), [entity, pos], "left")
