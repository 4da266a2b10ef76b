"""Filters and quality rules: vetoes, outliers, one row or code for each key, masks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NULL_SAFE = "eqNullSafe"


def drop_entities_with_any(df: DataFrame, entity: str, predicate: Column) -> DataFrame:
    """Without every row of an entity that has any row for which the predicate holds; rows of a null entity stay."""
    return df.join(df.where(predicate).select(entity).distinct(), entity, "left_anti")


def id_subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def first_entities(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the n smallest keys."""
    return id_subset(df, df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n), key)


def group_bounds(df: DataFrame, cols: list[str], group: str | None, k: float = 4.0, min_n: int = 10, min_std: float = 1e-6) -> DataFrame:
    """For each group and column ``c`` the bounds c__lo and c__hi beyond which a value is an outlier; null where the
    group has fewer than ``min_n`` values or next to no spread. One aggregation for all columns."""
    aggs = []
    for c in cols:
        n, m, s = F.count(c), F.avg(c), F.stddev_samp(c)
        ok = (n >= min_n) & (s >= min_std)
        aggs += [F.when(ok, m - k * s).alias(f"{c}__lo"), F.when(ok, m + k * s).alias(f"{c}__hi")]
    return (df.groupBy(group) if group else df.groupBy()).agg(*aggs)


def null_outliers(df: DataFrame, cols: list[str], bounds: DataFrame, group: str | None) -> DataFrame:
    """Values strictly beyond their group's bounds become null."""
    if group:
        b = bounds.withColumnRenamed(group, "__g")
        joined = df.join(b, df[group].eqNullSafe(b["__g"]), "left")
    else:
        joined = df.crossJoin(bounds)  # one row
    out = {c: F.when((F.col(c) < F.col(f"{c}__lo")) | (F.col(c) > F.col(f"{c}__hi")), None).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(out).select(*df.columns)


def null_group_outliers(df: DataFrame, cols: list[str], group: str | None, k: float = 4.0, min_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(df with outliers nulled, one row with the count of nulled values for each column)."""
    out = null_outliers(df, cols, group_bounds(df, cols, group, k, min_n), group)
    before, after = df.agg(*[F.count(c).alias(c) for c in cols]), out.agg(*[F.count(c).alias(f"_{c}") for c in cols])
    return out, before.crossJoin(after).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in cols])


def null_by_bounds(df: DataFrame, stats: DataFrame, col: str, value: str, k: float = 4.0, min_n: int = 10, min_std: float = 1e-6) -> DataFrame:
    """Long form: values beyond mean +- k std of a given table (col, n, mean, std) become null; n must exceed ``min_n``."""
    s = stats.where((F.col("n") > min_n) & (F.col("std") > min_std)).select(F.col(col).alias("__c"), (F.col("mean") - k * F.col("std")).alias("__lo"), (F.col("mean") + k * F.col("std")).alias("__hi"))
    joined = df.join(s, df[col].eqNullSafe(s["__c"]), "left")
    return joined.withColumn(value, F.when((F.col(value) < F.col("__lo")) | (F.col(value) > F.col("__hi")), None).otherwise(F.col(value))).select(*df.columns)


def one_code_per_key(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """The most frequent code of each key; the smallest on ties."""
    return df.where(F.col(code).isNotNull()).groupBy(*keys, code).count().groupBy(*keys).agg(F.min_by(code, F.struct(-F.col("count"), F.col(code))).alias(code))


def multi_code_audit(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Keys with more than one distinct code."""
    return df.groupBy(*keys).agg(F.count_distinct(code).alias("n_codes")).where("n_codes > 1")


def prefer_matching_row(df: DataFrame, chosen: DataFrame, keys: list[str], code: str, order: list[str]) -> DataFrame:
    """One row for each key: the first whose code is the chosen one, else the first."""
    c = chosen.select(*keys, F.col(code).alias("__code"))
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(code) == F.col("__code"), F.lit(False)).desc(), *order)
    return df.join(c, keys, "left").withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First write wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def duplicate_report(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """(entity, n_keys, n_extra): entities with repeated keys, how many keys and how many rows too many."""
    again = df.groupBy(entity, *keys).count().where("count > 1")
    return again.groupBy(entity).agg(F.count("*").alias("n_keys"), F.sum(F.col("count") - 1).alias("n_extra"))


def loss_mask(df: DataFrame, targets: list[str], known: list[str], status: str, cleared: list[str]) -> DataFrame:
    """A column t__mask for each target: observed, its statistics exist, and the row's status is not one that clears."""
    clear = F.coalesce(F.col(status).isin(cleared), F.lit(False))
    return df.withColumns({f"{t}__mask": (F.col(t).isNotNull() & ~clear) if t in known else F.lit(False) for t in targets})


def identity_gate(df: DataFrame, entity: str, match: Column, aligned: Column, least: float = 0.8) -> DataFrame:
    """(entity, n_aligned, identity) of the entities whose share of matches is at least ``least``."""
    n = F.sum(F.when(aligned, 1).otherwise(0))
    share = F.try_divide(F.sum(F.when(match & aligned, 1).otherwise(0)), n)
    return df.groupBy(entity).agg(n.alias("n_aligned"), share.alias("identity")).where(F.col("identity") >= least)


def stamp_folds(df: DataFrame, folds: DataFrame, key: str, marker: str = "stamped") -> DataFrame:
    """Rows with their fold and the marker that says where it comes from; keys without a fold get -1 and no marker."""
    f = folds.select(key, F.col("fold").alias("__f"))
    out = df.drop("fold", "provenance").join(f, key, "left")
    return out.withColumn("provenance", F.when(F.col("__f").isNotNull(), F.lit(marker))).withColumn("fold", F.coalesce("__f", F.lit(-1))).drop("__f")


def provenance_summary(df: DataFrame, column: str, marker: str = "stamped") -> DataFrame:
    ok = F.coalesce(F.col(column) == marker, F.lit(False))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_bad"), (F.coalesce(F.bool_and(ok), F.lit(False))).alias("stamped"))


def gate(df: DataFrame, name: str, bad: Column, least: int = 0) -> DataFrame:
    """One row (gate, n_rows, n_bad, passed): a gate is passed if no row is bad (null counts as bad) and there are ``least`` rows. An aggregation, so that
    the gates of a pipeline can be unioned, written and read before anything that depends on them starts."""
    off = F.count(F.when(F.coalesce(bad, F.lit(True)), 1))
    return df.agg(F.lit(name).alias("gate"), F.count("*").alias("n_rows"), off.alias("n_bad"), ((off == 0) & (F.count("*") >= least)).alias("passed"))


def require_gates(gates: DataFrame) -> None:
    """Fail closed: an error that names the gates that were not passed; one row a gate comes to the driver."""
    if failed := gates.where("not passed").collect():
        raise ValueError("not passed: " + ", ".join(f"{r['gate']} ({r['n_bad']} of {r['n_rows']} rows)" for r in failed))


def require_stamped(df: DataFrame, column: str = "provenance", marker: str = "stamped") -> DataFrame:
    """``df``, or an error before anything is written if the marker is missing in any row, or there is no row."""
    if column not in df.columns or not provenance_summary(df, column, marker).first()["stamped"]:
        raise ValueError(f"the split is not {marker}: column {column!r} is missing or has other values")
    return df


def require_none(df: DataFrame, what: str) -> None:
    """Fail closed: an error that shows a few of the offending rows."""
    if rows := df.take(5):
        raise ValueError(f"{what}: {rows}")
