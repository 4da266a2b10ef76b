"""Column expressions: codes, scalings, vectors, hash folds. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import constants as C


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def one_letter(code: Column) -> Column:
    """A residue's letter; anything else, null too, is X."""
    return F.coalesce(F.try_element_at(literal_map(C.ONE_LETTER), F.upper(code)), F.lit("X"))


def is_amino(code: Column) -> Column:
    """A known residue that is neither a nucleotide nor a two-letter D name; false for null."""
    known = F.upper(code).isin(C.RESIDUES) & ~F.upper(code).isin(C.NUCLEOTIDES) & ~F.upper(code).rlike("^D.$")
    return F.coalesce(known, F.lit(False))


def is_hydrogen(atom: Column) -> Column:
    """Starts with H, or with a digit and H; blank and null are heavy."""
    return F.coalesce(F.trim(atom).rlike("^(H|[0-9]H)"), F.lit(False))


def code_of(value: Column, vocabulary: list[str]) -> Column:
    """Place in the vocabulary, from 0; anything else, null too, is the vocabulary's length."""
    return F.coalesce(F.try_element_at(literal_map({v: i for i, v in enumerate(vocabulary)}), value), F.lit(len(vocabulary)))


def angle_features(*degrees: Column) -> list[Column]:
    """Sine and cosine of each angle; null angles give 0."""
    return [F.coalesce(f(F.radians(a)), F.lit(0.0)) for a in degrees for f in (F.sin, F.cos)]


def scale_clip(value: Column, scale: float, low: float, high: float) -> Column:
    """value / scale within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value / scale)))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.coalesce((v == value).cast("int"), F.lit(0)))


def struct_vector(distances: list[Column], cloud: list[Column], angles: list[Column], report: list[Column], group: Column, vocabulary: list[str]) -> Column:
    """One fixed-size array: distances, cloud summary, sines and cosines, report columns, one-hot class; null is 0."""
    flat = [*distances, *cloud, *angle_features(*angles), *report]
    return F.concat(F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in flat]), F.transform(one_hot(group, vocabulary), lambda x: x.cast("double")))


def neighbour_features(distance: Column, separation: Column) -> list[Column]:
    """distance / 15 and log1p(|separation|) / 5; null is 0."""
    return [F.coalesce(distance / 15.0, F.lit(0.0)), F.coalesce(F.log1p(F.abs(separation)) / 5.0, F.lit(0.0))]


def transferred(value: Column, base_from: Column, base_to: Column) -> Column:
    """A value moved from one base line to another; unchanged where either base is missing."""
    return F.coalesce(base_to + (value - base_from), value)


def md5_fold(key: Column, n: int, prefix: str = "") -> Column:
    """1 + (the key's MD5 as a 128-bit number) mod n, taken over four 32-bit pieces; n below 2**31."""
    digest = F.md5(F.concat(F.lit(prefix), key.cast("string")).cast("binary"))
    pieces = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return (reduce(lambda rest, p: (rest * (1 << 32) + p) % n, pieces, F.lit(0).cast("long")) + 1).cast("int")


def atom_of(column: Column, suffix: str = "_shift") -> Column:
    return F.upper(F.regexp_replace(column, f"{suffix}$", ""))


def is_backbone(atom: Column) -> Column:
    return F.coalesce(atom.isin(C.BACKBONE), F.lit(False))


def random_coil(spark: SparkSession) -> DataFrame:
    """(residue, atom, shift); atoms without a value are absent."""
    rows = [(r, a, v) for r, values in C.RANDOM_COIL.items() for a, v in zip(C.RANDOM_COIL_ATOMS, values, strict=True) if v is not None]
    return spark.createDataFrame(rows, "residue string, atom string, shift double")


def ablate(df: DataFrame, groups: dict[str, list[str]], names: list[str]) -> DataFrame:
    """The columns of the named feature groups set to zero, or to an empty array; an unknown name is an error."""
    if unknown := sorted(set(names) - set(groups)):
        raise ValueError(f"unknown feature groups: {unknown}")
    kinds = dict(df.dtypes)
    zero = lambda c: F.array().cast(kinds[c]) if kinds[c].startswith("array") else F.lit(0).cast(kinds[c])
    return df.withColumns({c: zero(c) for g in names for c in groups[g]})
