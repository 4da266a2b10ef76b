"""Long to wide, priority joins, unions, sequences, best candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_first(df: DataFrame, keys: list[str], kind: str, values: list[str], kinds: list[str], order: str) -> DataFrame:
    """Wide rows with ``{kind}_{value}``: the first non-null value in document order; a fixed schema, one aggregation."""
    first = [
        F.min_by(F.col(v), F.when((F.col(kind) == k) & F.col(v).isNotNull(), F.col(order))).alias(f"{k.lower()}_{v}") for k in kinds for v in values
    ]
    return df.groupBy(*keys).agg(*first)


def choose_source(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The primary, the fallback and their hybrid (primary where there is one) as one table tagged ``dataset``."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    tag = lambda d, name: d.withColumn("dataset", F.lit(name))
    hybrid = primary.unionByName(rest)
    return tag(hybrid, "hybrid").unionByName(tag(primary, "experimental")).unionByName(tag(fallback, "predicted"))


def merge_maps(dfs: list[DataFrame], key: str, value: str, mode: str = "update") -> DataFrame:
    """Later tables overwrite earlier ones (``update``), or all values of a key as a sorted set (``union``)."""
    every = reduce(DataFrame.unionByName, [d.select(key, value, F.lit(i).alias("__p")) for i, d in enumerate(dfs)])
    if mode == "union":
        return every.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(value))
    return every.groupBy(key).agg(F.max_by(value, F.struct("__p", F.col(value))).alias(value))


def lookup_with_fallback(wanted: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first`` for the wanted keys, and of ``second`` for those keys that ``first`` lacks."""
    found = first.join(wanted.select(key).distinct(), key, "left_semi")
    missing = wanted.select(key).distinct().join(first.select(key), key, "left_anti")
    return found.unionByName(second.join(missing, key, "left_semi"))


def resolve_by_priority(wanted: DataFrame, listing: DataFrame, key: str, candidates: list[Column], name: str = "name") -> DataFrame:
    """The first candidate name, in order, that the listing has for each wanted row; null if none. ``listing`` is (name, path)."""
    tried = wanted.select(key, F.posexplode(F.array(*candidates)).alias("__rank", name))
    found = tried.join(listing.select(name, "path").hint("merge"), name).groupBy(key).agg(F.min_by("path", F.struct("__rank", "path")).alias("path"), F.min("__rank").alias("rank"))
    return wanted.join(found.hint("merge"), key, "left")


def fallback_join(left: DataFrame, right: DataFrame, variants: list[tuple[Column, str]], right_key: str, value: str) -> DataFrame:
    """``left`` with the value of the first key variant that ``right`` has; right keys are unique. Variants are (key, label)."""
    rows = left.withColumn("__id", F.struct(*left.columns))
    tried = rows.select("__id", F.posexplode(F.array(*[k for k, _ in variants])).alias("__rank", right_key)).distinct()
    best = tried.join(right.select(right_key, value).hint("merge"), right_key).groupBy("__id").agg(F.min_by(value, "__rank").alias(value))
    return rows.join(best.hint("merge"), "__id", "left").select(*left.columns, value)


def mapped_join(mapping: DataFrame, targets: DataFrame, structure: DataFrame, entity: str, code: str = "code", known: list[str] | None = None, report: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """Mapping rows (entity, struct_id, target_id, kind) with target and structure columns by position.

    The code is the target's, else the structure's if it is a known one, else UNK; the position is the structure's, else the
    target's. A target id that the targets lack drops the row. ``report`` (entity, pos, ...) and ``neighbours`` (entity, pos, slot, ...) hang on the
    structure's position too: the report's columns as they are, the neighbours as an array ``spatial`` in the order of their slots;
    null where the row has no structure or they lack it. All joins are on (entity, position) equality.
    """
    t = targets.withColumnRenamed("pos", "target_id").withColumnRenamed(code, "__t").withColumn("__has", F.lit(True))
    s = structure.withColumnRenamed("pos", "struct_id").withColumnRenamed(code, "__s")
    out = mapping.join(t, [entity, "target_id"], "left").where("target_id is null or __has").drop("__has").join(s, [entity, "struct_id"], "left")
    if report is not None:
        out = out.join(report.withColumnRenamed("pos", "struct_id").hint("merge"), [entity, "struct_id"], "left")
    if neighbours is not None:
        each = F.struct("slot", *[c for c in neighbours.columns if c not in (entity, "pos", "slot")])
        near = neighbours.groupBy(entity, F.col("pos").alias("struct_id")).agg(F.array_sort(F.collect_list(each)).alias("spatial"))
        out = out.join(near.hint("merge"), [entity, "struct_id"], "left")
    ok = F.when(F.col("__s").isin(known), F.col("__s")) if known is not None else F.col("__s")
    return out.withColumn(code, F.coalesce("__t", ok, F.lit("UNK"))).withColumn("pos", F.coalesce("struct_id", "target_id")).drop("__t", "__s")


def union_uniform(dfs: list[DataFrame]) -> DataFrame:
    """All rows under the union of all columns, in alphabetical order."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return out.select(sorted(out.columns))


def build_sequences(df: DataFrame, entity: str, pos: str, letter: Column, least: int = 10) -> DataFrame:
    """(entity, seq): one letter for each distinct position (the smallest on ties), in order; shorter ones are left out."""
    one = df.where(F.col(pos).isNotNull()).groupBy(entity, pos).agg(F.min(letter).alias("__l"))
    rows = F.array_sort(F.collect_list(F.struct(pos, "__l")))
    return one.groupBy(entity).agg(F.array_join(F.transform(rows, lambda z: z["__l"]), "").alias("seq")).where(F.length("seq") >= least)


def best_candidate(df: DataFrame, key: str, scores: list[str], order: str, value: str) -> DataFrame:
    """The candidate with the highest scores, compared in turn; the first in order on ties; null scores are lowest."""
    rank = F.struct(*[F.coalesce(F.col(s).cast("double"), F.lit(float("-inf"))) for s in scores], -F.col(order))
    return df.groupBy(key).agg(F.max_by(F.col(value), rank).alias(value), *[F.max_by(F.col(s), rank).alias(s) for s in scores])


def build_log(wanted: DataFrame, produced: DataFrame, key: str, error: str | None = None) -> DataFrame:
    """(key, n_rows, status): success, empty, or the error text that the worker returned for a wanted key."""
    text = F.max(error) if error else F.lit(None).cast("string")
    counts = produced.groupBy(key).agg(F.count(F.when(F.col(error).isNull(), 1) if error else F.lit(1)).alias("n_rows"), text.alias("__e"))
    status = F.when(F.col("n_rows") > 0, "success").when(F.col("__e").isNotNull(), F.concat(F.lit("error: "), F.col("__e"))).otherwise("empty")
    return wanted.select(key).distinct().join(counts, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long")).select(key, "n_rows", status.alias("status"))
