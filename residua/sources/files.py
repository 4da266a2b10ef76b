"""Pair lists, ids from file names, partitioned feature stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_pairs(df: DataFrame, id_col: str, list_col: str, sep: str = ",") -> DataFrame:
    """(id, item): the trimmed, upper-cased items of each row's list; null, empty and ``nan`` ones are left out."""
    item = F.upper(F.trim(F.col("item")))
    rows = df.where(F.col(id_col).isNotNull() & (F.trim(F.col(id_col).cast("string")) != "")).select(F.trim(F.col(id_col).cast("string")).alias("id"), F.explode(F.split(list_col, sep)).alias("item"))
    return rows.select("id", item.alias("item")).where("item is not null and item not in ('', 'NAN')")


def read_pairs(spark: SparkSession, path: str, id_col: str = "Entry_ID", list_col: str = "pdb_ids", sep: str = ",") -> DataFrame:
    """(id, item) of a CSV file with a header (quoted or not, after blank lines) and a list in the second column."""
    raw = spark.read.csv(path, header=False, schema=f"`{id_col}` string, `{list_col}` string", ignoreLeadingWhiteSpace=True, mode="PERMISSIVE")
    body = raw.where(F.col(id_col).isNotNull() & F.col(list_col).isNotNull() & (F.trim(F.regexp_replace(id_col, '"', "")) != id_col))
    return explode_pairs(body, id_col, list_col, sep)


def keys_from_paths(paths: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """The distinct groups of a pattern in the last part of each path; paths that do not match are left out."""
    base = F.element_at(F.split(column, "/"), -1)
    rows = paths.where(base.rlike(pattern))
    return rows.select(*[F.regexp_extract(base, pattern, i + 1).alias(n) for i, n in enumerate(names)]).distinct()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name) of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


#: Bytes of a row group of a store that is in order, so that its footers tell small ranges apart.
ROW_GROUP = 4 << 20


def write_feature_store(features: DataFrame, stats: DataFrame, path: str, fold: str = "fold", order: list[str] | None = None) -> None:
    """Features partitioned by fold, statistics beside them. A large fold is split into several tasks and files.

    With ``order`` (an entity and a position, say) files hold ranges of it and are sorted, in small row groups, so the footers' least and most values
    leave out nearly all of a fold when a range is read.
    """
    if order:
        dealt = features.repartitionByRange(fold, *order).sortWithinPartitions(fold, *order)
        dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy(fold).mode("overwrite").parquet(f"{path}/features")
    else:
        features.hint("rebalance", fold).write.partitionBy(fold).mode("overwrite").parquet(f"{path}/features")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_feature_store(spark: SparkSession, path: str, fold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, stats); of one fold, only its partition is read."""
    features = spark.read.parquet(f"{path}/features")
    return (features if fold is None else features.where(F.col("fold") == fold)), spark.read.parquet(f"{path}/stats")


def read_range(spark: SparkSession, path: str, fold: int, entity: str, value: object, pos: str, first: int, last: int) -> DataFrame:
    """The features of one entity of a fold from one position to another, both included. The conditions reach the scan, which opens the fold's partition alone and, in
    a store in the order of ``entity`` and ``pos``, reads only the row groups whose footers allow such rows."""
    features = spark.read.parquet(f"{path}/features")
    return features.where((F.col("fold") == fold) & (F.col(entity) == F.lit(value)) & F.col(pos).between(first, last))
