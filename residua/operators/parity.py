"""Whether two tables hold the same rows: digests by key range first, rows only where those differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.scratch import written

#: Ranges of hashed keys that have a digest each.
RANGES = 4096


def differences(one: DataFrame, other: DataFrame, keys: list[str], names: tuple[str, str] = ("one", "other"), ranges: int = RANGES) -> DataFrame:
    """(side, n_missing, n_rows): of each table's rows, how many the other lacks, counted as often as they stand there more often.

    Both tables have the same columns. A range of hashed keys has an order-free digest of its rows: their number and two sums of 64-bit row hashes with different
    seeds, as decimals that cannot overflow; sums see repeated rows, which a bitwise digest would not. Rows are compared themselves, by ``exceptAll``, only in
    ranges whose digests differ, of which there are ``ranges`` at most, so equal tables cost one aggregation and no shuffle of rows. Nulls equal nulls.
    """
    columns = one.columns
    place = F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias("range")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    sides = [x.select(*columns).groupBy(place).agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).withColumn("side", F.lit(i)) for i, x in enumerate((one, other))]
    digests = written(sides[0].unionByName(sides[1]), "digests")
    same = digests.groupBy("range").agg(F.count("*").alias("k"), F.count_distinct("n", "a", "b").alias("d")).where("k = 2 and d = 1")
    off = sorted(r["range"] for r in digests.select("range").distinct().join(same.hint("merge"), "range", "left_anti").collect())
    some = [x.select(*columns).where(F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").isin(off)) if off else x.select(*columns).limit(0) for x in (one, other)]
    rows = digests.groupBy("side").agg(F.sum("n").alias("n"))
    out = []
    for i, (own, others) in enumerate((some, some[::-1])):
        missing = own.exceptAll(others).agg(F.count("*").alias("n_missing")) if off else one.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_missing"))
        held = rows.where(F.col("side") == i).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        out.append(missing.crossJoin(held).select(F.lit(names[i]).alias("side"), "n_missing", "n_rows"))
    return out[0].unionByName(out[1])
