"""Leak-free splits: exclusion through components, hashed folds, holdout, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.expressions import md5_fold

EXCLUDED, HOLDOUT, UNMAPPED = 0, 6, -1


def exclusion_propagation(components: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """(id, component) of every member of a component that has a seed."""
    hit = components.join(seeds.select(key).distinct(), key, "left_semi").select("component").distinct()
    return components.join(hit, "component", "left_semi").select(key, "component")


def paired_exclusion(pairs: DataFrame, test_ids: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that are paired with any of the test ids."""
    return pairs.join(test_ids.select(F.col(test_ids.columns[0]).alias(other)).distinct(), other, "left_semi").select(key).distinct()


def assign_folds(components: DataFrame, excluded: DataFrame, n: int = 5, key: str = "id", group_prefix: str = "comp_", single_prefix: str = "bmrb_") -> DataFrame:
    """(id, component, fold, policy): 0 for excluded ids, else a hash of the component's canonical id if it has several
    members, else of the id itself."""
    sizes = components.groupBy("component").agg(F.count("*").alias("__n"))
    out = components.join(sizes, "component").join(excluded.select(key, F.lit(True).alias("__x")).distinct(), key, "left")
    many = F.col("__n") > 1
    fold = F.when(F.col("__x"), EXCLUDED).when(many, md5_fold(F.col("component"), n, group_prefix)).otherwise(md5_fold(F.col(key), n, single_prefix))
    policy = F.when(F.col("__x"), "excluded").when(many, "component").otherwise("single")
    return out.select(key, "component", fold.cast("int").alias("fold"), policy.alias("policy"))


def holdout_force(folds: DataFrame, listed: DataFrame, key: str = "id") -> DataFrame:
    """Listed ids, and all members of their components that have several members, move to the holdout; listed ids
    that the table lacks are added to it."""
    want = listed.select(key).distinct()
    sizes = folds.groupBy("component").agg(F.count("*").alias("__n"))
    hit = folds.join(want, key, "left_semi").select("component").distinct().join(sizes.where("__n > 1"), "component", "left_semi")
    forced = folds.join(hit, "component", "left_semi").select(key).unionByName(want).distinct().withColumn("__h", F.lit(True))
    out = folds.join(forced, key, "full_outer")
    return out.select(
        key,
        F.coalesce("component", key).alias("component"),
        F.when(F.col("__h"), F.lit(HOLDOUT)).otherwise(F.col("fold")).alias("fold"),
        F.when(F.col("__h"), F.lit("holdout")).otherwise(F.col("policy")).alias("policy"),
    )


def fold_counts(df: DataFrame, fold: str, key: str) -> DataFrame:
    return df.groupBy(fold).agg(F.count_distinct(key).alias("n_ids"), F.count("*").alias("n_rows"))


def unmapped(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Keys without a fold."""
    return df.select(key).distinct().join(folds.select(key), key, "left_anti")


def leakage_report(folds: DataFrame, groups: DataFrame, excluded: DataFrame, key: str = "id", group: str = "grp") -> DataFrame:
    """(check, n): components and groups that span several folds but 0, and excluded ids in a training fold."""
    used = folds.where(F.col("fold") > EXCLUDED)
    spans = lambda d, by: d.groupBy(by).agg(F.count_distinct("fold").alias("k")).where("k > 1")
    comps = spans(used, "component").agg(F.count("*").alias("n")).select(F.lit("components").alias("check"), "n")
    grouped = spans(used.join(groups.select(key, group), key), group).agg(F.count("*").alias("n")).select(F.lit("groups").alias("check"), "n")
    bad = used.where(F.col("fold") < HOLDOUT).join(excluded.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit("excluded").alias("check"), "n")
    return comps.unionByName(grouped).unionByName(bad)


def require_no_leak(report: DataFrame) -> None:
    if leaks := report.where("n > 0").collect():  # three rows at most
        raise ValueError(f"leaks: {leaks}")


def exclusion_map(components: DataFrame, key: str = "id") -> DataFrame:
    """(id, others): the other members of each id's component, sorted; ids that are alone are left out. Its size is the square of the components', so
    for large ones use ``exclusion_members``.

    The result lists every member beside every other, as the map is defined; one row at a time is built from the
    component's sorted members.
    """
    members = components.groupBy("component").agg(F.sort_array(F.collect_list(key)).alias("m")).where(F.size("m") > 1)
    return members.select(F.explode("m").alias(key), "m").select(key, F.array_remove("m", F.col(key)).alias("others"))


def exclusion_members(components: DataFrame, key: str = "id") -> DataFrame:
    """(id, component, n_others): the exclusion map as membership, one row for each id that is not alone, however large its component; the
    others of an id are the rows of its component."""
    n = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return components.select(key, "component").join(n.hint("merge"), "component").select(key, "component", (F.col("n") - 1).alias("n_others"))


def write_by_fold(df: DataFrame, path: str, fold: str = "fold") -> None:
    """One partition for each fold; rows without a fold (-1 or null) are not written. A large fold is split into several tasks and files."""
    df.where(F.col(fold) >= 0).hint("rebalance", fold).write.partitionBy(fold).mode("overwrite").parquet(path)
