"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm import words as W
from residua.operators.ranking import running
from residua.scratch import written

#: Seeds that each source may choose from.
SEEDS = 64
WORDS = r"[^\x20\x09-\x0D]+"
#: A table of sources is broadcast up to so many rows, by count.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """(source, source_size, target) from a table with one row for each source.

    Sources in the order of their code points, null last, take ``weights`` in turn. Targets share the sum of all
    sizes by weight, but stop at ``ceiling`` times the source's own size, and what is above is shared anew by weight.
    That ends where every source has the smaller of its ceiling and one common level times its weight; the level is
    the first, in order of ceiling over weight, that leaves the rest of the sources below their ceilings. Places and
    sums come from range partitions, so that the number of sources is not bounded by a task.
    """
    own = sizes.select(F.col(source).alias("_source"), F.col(size).alias("_size"))
    place = running(own, [F.col("_source").isNull(), F.col("_source")], {"_place": F.lit(1)})
    w = place.withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
    ratio = F.col("_size") / F.col("_w")
    order = [ratio, F.col("_source").isNull(), F.col("_source")]
    w = written(running(w, order, {"_sizes": F.col("_size"), "_ws": F.col("_w")}), "weighed")
    total = w.agg(F.sum("_size").alias("_all_sizes"), F.sum("_w").alias("_all_ws"))
    left = F.col("_all_sizes") - ceiling * F.col("_sizes")
    level = w.crossJoin(F.broadcast(total)).withColumn("_level", left.cast("double") / (F.col("_all_ws") - F.col("_ws")).cast("double"))
    fits = F.col("_level") * F.col("_w").cast("double") <= ceiling * F.col("_size").cast("double")
    one = level.where(fits).agg(F.min_by("_level", F.struct(ratio, F.col("_source").isNull(), F.col("_source"))).alias("_level"))
    capped = ceiling * F.col("_size").cast("double")
    target = F.least(capped, F.col("_level") * F.col("_w").cast("double"))
    return w.crossJoin(F.broadcast(one)).select(F.col("_source").alias(source), F.col("_size").alias("source_size"), F.coalesce(target, capped).alias("target"))


def draw(key: Column, seed: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the key and the seed alone: one digest of the key gives a start and an odd step, so each
    seed's draws are uniform, and those of two seeds independent of each other."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return (part(1) + seed * (part(9).bitwiseOR(F.lit(1)))).bitwiseAND(F.lit((1 << 32) - 1))


def _with_rates(rows: DataFrame, source: str, rates: DataFrame, tag: str = "") -> DataFrame:
    """``rows`` beside their source's rates, whose columns get ``tag`` before their names. The rates are broadcast if a count shows few; else both sides are
    plain shuffles, of which a hot source's is split."""
    hint = "broadcast" if rates.count() <= BROADCAST_SOURCES else "merge"
    rates = rates.toDF(*[tag + c for c in rates.columns])
    return rows.join(rates.hint(hint), rows[source].eqNullSafe(rates[f"{tag}_source"]))


def source_rates(df: DataFrame, key: str, source: str, size: str, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seeds: int = SEEDS) -> DataFrame:
    """One row for each source: (_source, source_size, target, _whole, _rest, _seed), which is all that says how often a row is emitted.

    A source's rate is target over size. Every row is emitted floor(rate) times, and once more if its draw under
    the source's seed falls below the rate's fraction. Of ``seeds`` fixed seeds each source takes the one whose total comes
    nearest its target (the smaller seed on ties), found in one aggregation of ``seeds`` sums for each source. Under each fixed seed a
    row's extra copy is a Bernoulli draw with the fraction as its probability; under the one picked it no longer is, strictly, since
    the pick looks at the outcome.
    Null sources form a source; sources without any words have target 0 and rate 0; reruns give the same.
    """
    sized = written(df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).alias("_size")), "sizes")
    totals = written(sized.groupBy("_source").agg(F.sum("_size").alias("_size")), "totals")
    targets = source_targets(totals, "_source", "_size", weights, ceiling)
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    targets = written(targets.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_rest", rate - F.floor(rate)), "targets")
    limit = F.col("_rest") * float(1 << 32)
    own = sized.withColumnRenamed("_source", "_of")
    rated = _with_rates(own, "_of", targets).select("_of", "_size", limit.alias("_limit"), draw(F.col("_key"), F.lit(0)).alias("_a"), (draw(F.col("_key"), F.lit(1)) - draw(F.col("_key"), F.lit(0))).alias("_b"))
    drawn = lambda k: (F.col("_a") + k * F.col("_b")).bitwiseAND(F.lit((1 << 32) - 1))
    sums = written(rated.groupBy("_of").agg(*[F.sum(F.when(drawn(k) < F.col("_limit"), F.col("_size")).otherwise(0)).alias(f"_s{k}") for k in range(seeds)]), "sums")
    off = lambda k: F.abs(F.col("_whole") * F.col("source_size") + F.col(f"_s{k}") - F.col("target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]))["seed"]
    return written(_with_rates(sums, "_of", targets).select("_source", "source_size", "target", "_whole", "_rest", best.cast("long").alias("_seed")), "rates")


def _copies(key: Column, tag: str = "") -> Column:
    return F.col(f"{tag}_whole") + (draw(key, F.col(f"{tag}_seed")) < F.col(f"{tag}_rest") * float(1 << 32)).cast("long")


def mix_rates(df: DataFrame, key: str, source: str, size: str, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seeds: int = SEEDS) -> DataFrame:
    """(key, source, size, source_size, target, copies) for each row of ``df``, whatever else it has; see ``source_rates``."""
    sized = written(df.select(key, source, size), "sizes")
    rates = source_rates(sized, key, source, size, weights, ceiling, seeds)
    return _with_rates(sized, source, rates).select(key, source, size, "source_size", "target", _copies(F.col(key)).alias("copies"))


def emit_copies(docs: DataFrame, key: str, source: str, rates: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as their source's row of ``rates`` and their own draw say.

    Copies follow from the row's own key and source, so repeated keys, even of several sources, are each emitted on their own; a null key draws as
    the empty string does. ``docs`` may have columns of any name.
    """
    tag = W.free_prefix(docs.columns)
    n = _with_rates(docs, source, rates, tag).withColumn(f"{tag}n", _copies(docs[key], tag)).where(F.col(f"{tag}n") > 0)
    return n.withColumn(f"{tag}n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{tag}n")))).select(*[docs[c] for c in docs.columns])
