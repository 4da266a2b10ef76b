"""Running sums and ranks over a whole table in one global order, without a window that holds all rows in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.scratch import written


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum of its expression over all rows before this one in ``order``.

    Rows are dealt to ranges of the order and summed inside their range; one number a range and sum, so as many as
    there are shuffle partitions, carries what stands before. Null counts as 0. Rows equal in ``order`` stand in any
    order. Names in ``sums`` must be new; an empty table stays empty.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_of_{name}") for name, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_part", *[F.coalesce(F.sum(f"_of_{name}").over(before), F.lit(0)).alias(f"_of_{name}") for name in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(held), "_part")
    for name, c in sums.items():
        out = out.withColumn(name, F.col(f"_of_{name}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.select(*df.columns, *sums)


#: One part in so many of all rows is the rank error of the quantile sketch; bands of more rows are sketched again.
ACCURACY, BAND = 10_000, 100_000


def _bands(kept: DataFrame, at: dict[str, float]) -> tuple[int, dict[str, tuple[float, float, int]]]:
    """How many values there are, and for each percentile two values with at most ``BAND`` rows from one to the other (or one value), with the ranks of
    the percentile between them, and how many rows stand below.

    A mergeable quantile sketch proposes the bands and exact counts confirm them: a side that would miss a rank stays where it was, a band with too many rows is sketched
    anew from its rows alone. One row of numbers comes back from each pass.
    """
    first = kept.agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    n = first["n"]
    if not n:
        return 0, {}
    # the least and the most value, the rows below the one and up to the other; the counts are exact
    sure = {name: (first["lo"], first["hi"], 0, n) for name in at}
    wide = lambda name: sure[name][3] - sure[name][2] > BAND and sure[name][0] < sure[name][1]
    open_ = [name for name in at if wide(name)]
    while open_:
        sketches = []
        for name in open_:
            lo, hi, below, until = sure[name]
            place = ((n - 1) * at[name] - below) / (until - below)
            inside = F.when((F.col("_v") >= lo) & (F.col("_v") <= hi), F.col("_v"))
            sketches.append(F.percentile_approx(inside, [max(0.0, place - 2 / ACCURACY), min(1.0, place + 2 / ACCURACY)], ACCURACY).alias(name))
        told = kept.agg(*sketches).first()
        counts = []
        for name in open_:
            counts += [F.count(F.when(F.col("_v") < told[name][0], 1)).alias(f"b_{name}"), F.count(F.when(F.col("_v") <= told[name][1], 1)).alias(f"u_{name}")]
        seen = kept.agg(*counts).first()
        again = []
        for name in open_:
            lo, hi, below, until = sure[name]
            place, b, u = (n - 1) * at[name], seen[f"b_{name}"], seen[f"u_{name}"]
            sure[name] = (*((told[name][0], hi, b) if b <= math.floor(place) else (lo, hi, below)), until)
            if u > math.ceil(place):
                sure[name] = (sure[name][0], told[name][1], sure[name][2], u)
            if wide(name) and sure[name] != (lo, hi, below, until):
                again.append(name)
        open_ = again
    return n, {name: (lo, hi, below) for name, (lo, hi, below, _) in sure.items()}


def _exact(kept: DataFrame, at: dict[str, float]) -> DataFrame:
    """One row of percentiles: of all rows only those in the bands are counted by value and ranked."""
    n, bands = _bands(kept, at)
    if not n:
        return kept.agg(*[F.max("_v").alias(name) for name in at])
    inside = {name: (F.col("_v") >= lo) & (F.col("_v") <= hi) for name, (lo, hi, _) in bands.items()}
    counts = kept.where(reduce(lambda x, y: x | y, inside.values())).groupBy("_v").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumns({f"_r_{name}": F.coalesce(F.sum(F.when(ok, F.col("_n"))).over(before), F.lit(0)) + bands[name][2] for name, ok in inside.items()})
    held, pick = [], []
    for name, p in at.items():
        place = (n - 1) * float(p)
        for side, rank in (("lo", math.floor(place)), ("hi", math.ceil(place))):
            held.append(F.max(F.when(inside[name] & (F.col(f"_r_{name}") <= rank) & (F.col(f"_r_{name}") + F.col("_n") > rank), F.col("_v"))).alias(f"_{side}_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        pick.append((lo if place == math.floor(place) else (math.ceil(place) - place) * lo + (place - math.floor(place)) * hi).alias(name))
    return ranked.agg(*held).select(*pick)


def order_statistics(df: DataFrame, value: str, at: dict[str, float], by: str | None = None) -> DataFrame:
    """One row (of each value of ``by``) with the exact percentiles ``at`` (name: fraction) of the values that are not null, linearly interpolated.

    Without ``by``, sketches and counts narrow each percentile to a band of few rows, and only those are ranked, so little more than sums is
    shuffled; ``df`` is read several times, so give a table and not a long plan. With ``by``, a value's rank comes from the ranges of ``running``, so no task and no buffer holds
    all values; only the two rows beside each percentile are kept. Null in an empty table.
    """
    if by is None:
        return _exact(df.select(F.col(value).cast("double").alias("_v")).where("_v is not null"), at)
    keys = [by]
    kept = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = kept.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranked = written(running(counts, [*keys, "_v"], {"_before": F.col("_n")}), "ranked")
    own = ranked.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_before").alias("_base"))
    both = ranked.join(own.hint("merge"), by)
    first, last = F.col("_before") - F.col("_base"), F.col("_before") - F.col("_base") + F.col("_n") - 1
    out = []
    for name, p in at.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            out.append(F.max(F.when((rank >= first) & (rank <= last), F.col("_v"))).alias(f"_{side}_{name}"))
    found = both.groupBy(*keys).agg(*out, F.max("_all").alias("_all"))
    pick = []
    for name, p in at.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        # the weights of a percentile between two ranks; on a rank, its value itself
        pick.append(F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    return found.select(*keys, *pick)
