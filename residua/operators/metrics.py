"""Prediction metrics, baselines, losses and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.functions import constants as C
from residua.operators.ranking import order_statistics
from residua.scratch import beside, written


def _squares(y: str, p: str) -> list[Column]:
    e = F.col(p) - F.col(y)
    n, rest = F.count(e), F.sum(e * e)
    total = F.var_pop(F.when(e.isNotNull(), F.col(y))) * n
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(total > 0, 1 - rest / total).otherwise(0.0).alias("r2"),
        n.alias("n"),
        F.avg(F.when(e.isNotNull(), F.col(y))).alias("mean_true"),
        F.stddev_pop(F.when(e.isNotNull(), F.col(y))).alias("std_true"),
    ]


def metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, R2 (0 for a constant truth), n, mean and population deviation of the truth, for each group; pairs with
    a null are left out, and so are groups without pairs."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(*_squares(y, p))


def metrics_overall(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: MAE, RMSE, median and 95th percentile of the absolute error, n; zeros without any pair. The percentiles are exact and come from ranges."""
    e = written(df.select(F.abs(F.col(p) - F.col(y)).cast("double").alias("e")).where("e is not null"), "errors")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    sums = e.agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("e").alias("n"))
    both = sums.crossJoin(F.broadcast(order_statistics(e, "e", {"median": 0.5, "p95": 0.95})))
    return both.select(zero(F.col("mae"), "mae"), zero(F.col("rmse"), "rmse"), zero(F.col("median"), "median"), zero(F.col("p95"), "p95"), "n")


def metrics_by_entity(df: DataFrame, y: str, p: str, entity: str) -> DataFrame:
    """One row: the distribution of the entities' mean absolute errors."""
    per = written(metrics(df, y, p, [entity]).select("mae"), "errors")
    sums = per.agg(F.count("*").alias("n_entities"), F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("std"), F.min("mae").alias("best"), F.max("mae").alias("worst"))
    return sums.crossJoin(F.broadcast(order_statistics(per, "mae", {"median": 0.5}))).select("n_entities", "mean", "median", "std", "best", "worst")


def baselines(df: DataFrame, stats: DataFrame, base: DataFrame, kind: str, y: str, group: str) -> DataFrame:
    """(kind, baseline, mae, n) of the training mean (kind, mean), of the group's base value (group, kind, shift) and of the
    unweighted mean of the kind's base values; rows without a value are skipped."""
    mean = df.join(stats.select(kind, F.col("mean").alias("p")), kind).withColumn("baseline", F.lit("train_mean"))
    own = df.join(base.select(group, kind, F.col("shift").alias("p")), [group, kind]).withColumn("baseline", F.lit("base"))
    flat = df.join(base.groupBy(kind).agg(F.avg("shift").alias("p")), kind).withColumn("baseline", F.lit("base_mean"))
    rows = mean.select(kind, "baseline", y, "p").unionByName(own.select(kind, "baseline", y, "p")).unionByName(flat.select(kind, "baseline", y, "p"))
    e = F.abs(F.col("p") - F.col(y))
    return rows.where(e.isNotNull()).groupBy(kind, "baseline").agg(F.avg(e).alias("mae"), F.count(e).alias("n"))


def macro_summary(per_type: DataFrame, flag: str, mae: str = "mae", against: str = "baseline_mae") -> DataFrame:
    """For each class of types: unweighted means of both errors and the improvement in percent."""
    out = per_type.groupBy(flag).agg(F.avg(mae).alias("mae"), F.avg(against).alias("baseline_mae"), F.count("*").alias("n_types"))
    return out.withColumn("improvement", F.try_divide((F.col("baseline_mae") - F.col("mae")) * 100.0, F.col("baseline_mae")))


def z_mae(df: DataFrame, kind: str, z_error: str) -> DataFrame:
    """One row: the mean over types of the mean absolute z error."""
    return df.where(F.col(z_error).isNotNull()).groupBy(kind).agg(F.avg(F.abs(F.col(z_error))).alias("m")).agg(F.avg("m").alias("z_mae"), F.count("*").alias("n_types"))


def huber_of(error: Column, delta: float = 0.5) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def huber(df: DataFrame, y: str, p: str, weight: Column, delta: float = 0.5) -> DataFrame:
    """One row: the mean over observed values of loss times weight (not divided by the weights); 0 without any."""
    e = F.col(p) - F.col(y)
    return df.agg(F.coalesce(F.avg(F.when(~F.isnan(e), huber_of(e, delta) * weight)), F.lit(0.0)).alias("loss"), F.count(e).alias("n"))


def swap_huber(df: DataFrame, key: list[str], kind: str, y: str, p: str, groups: DataFrame, pairs: DataFrame, delta: float = 0.5, residue: str | None = None, present: list[str] | None = None) -> DataFrame:
    """One row: Huber loss with equivalent kinds sharing one weight and swappable pairs scored by the better assignment.

    ``groups`` is (kind, grp): the members of a group weigh 1 / N for N of 2 or more, where N counts those that the row has observed, or, if ``present`` lists
    the kinds that are predicted, those among them. ``pairs`` is (kind, other): where both are observed, each takes half the smaller of the direct
    and the swapped sum. With ``residue``, a column of ``df``, both tables are (residue, kind, ...) and hold for that residue alone: what is equivalent
    in one need not be in another. A kind that stands in several groups or pairs of a residue counts in the first by name.
    """
    own = [residue] if residue else []
    grp = groups.groupBy(*own, kind).agg(F.min("grp").alias("grp"))
    both = pairs.select(*own, kind, "other").unionByName(pairs.select(*own, F.col("other").alias(kind), F.col(kind).alias("other"))).groupBy(*own, kind).agg(F.min("other").alias("other"))
    # written, since rows meet their mates in a join of the table with itself
    seen = written(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()), "seen")
    w = seen.join(beside(grp), [*own, kind], "left")
    if present is None:
        n = F.count("*").over(Window.partitionBy(*key, "grp"))
    else:
        sizes = grp.where(F.col(kind).isin(present)).groupBy(*own, "grp").agg(F.count("*").alias("__n"))
        w, n = w.join(beside(sizes), [*own, "grp"], "left"), F.coalesce(F.col("__n"), F.lit(1))
    w = w.withColumn("weight", F.when(F.col("grp").isNotNull(), 1.0 / n).otherwise(1.0))
    mate = seen.select(*key, F.col(kind).alias("other"), F.col(y).alias("__y"), F.col(p).alias("__p"))
    w = w.join(beside(both), [*own, kind], "left").join(mate.hint("merge"), [*key, "other"], "left")
    direct = huber_of(F.col(p) - F.col(y), delta)
    swapped = huber_of(F.col(p) - F.col("__y"), delta) + huber_of(F.col("__p") - F.col(y), delta)
    straight = direct + huber_of(F.col("__p") - F.col("__y"), delta)
    loss = F.when(F.col("__y").isNotNull(), 0.5 * F.least(straight, swapped)).otherwise(direct)
    return w.agg(F.coalesce(F.avg(loss * F.col("weight")), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))


def loss_tables(spark: SparkSession, kind: str = "kind", residue: str = "residue") -> tuple[DataFrame, DataFrame]:
    """(groups, pairs) of the fixed values: (residue, kind, grp) and (residue, kind, other)."""
    groups = [(r, a, g) for r, gs in C.EQUIVALENT.items() for g in gs for a in g.split()]
    pairs = [(r, *x.split()) for r, xs in C.SWAPPABLE.items() for x in xs]
    return spark.createDataFrame(groups, f"{residue} string, {kind} string, grp string"), spark.createDataFrame(pairs, f"{residue} string, {kind} string, other string")


def cap_stats(df: DataFrame, count: str, cap: int) -> DataFrame:
    """One row on the counts above 0: mean, median, 95th and 99th percentile, maximum, share at the cap."""
    c = F.col(count)
    own = written(df.where(c > 0).select(count), "counts")
    sums = own.agg(F.avg(c).alias("mean"), F.max(c).alias("most"), F.avg((c >= cap).cast("double")).alias("at_cap"))
    return sums.crossJoin(F.broadcast(order_statistics(own, count, {"median": 0.5, "p95": 0.95, "p99": 0.99}))).select("mean", "median", "p95", "p99", "most", "at_cap")


def error_histogram(df: DataFrame, error: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """(bin, n, density) of the errors within [low, high]; the last bin has its upper end."""
    width = (high - low) / bins
    e = F.col(error)
    b = F.least(F.floor((e - low) / width), F.lit(bins - 1)).cast("int")
    out = df.where((e >= low) & (e <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # at most ``bins`` rows
    return out.withColumn("density", F.col("n") / (total * width))


def percentile_ladder(df: DataFrame, error: str, steps: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(q, value): exact percentiles of the absolute errors."""
    e = written(df.select(F.abs(F.col(error)).alias("e")), "errors")
    found = order_statistics(e, "e", {f"p{i}": s for i, s in enumerate(steps)})
    return found.select(F.explode(F.array(*[F.struct(F.lit(s).alias("q"), F.col(f"p{i}").alias("value")) for i, s in enumerate(steps)])).alias("z")).select("z.q", "z.value")


def correlation(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(y, p).alias("r"), F.count(F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), 1)).alias("n"))


def top_types(df: DataFrame, kind: str, n: int = 6) -> DataFrame:
    """The n most frequent types, the smaller name on ties."""
    return df.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), kind).limit(n)


def best_run(log: DataFrame, run: str, step: str, metric: str, seconds: str) -> DataFrame:
    """(run, best_step, best, mean_seconds): the step with the least metric, the first on ties."""
    return log.groupBy(run).agg(F.min_by(step, F.struct(metric, step)).alias("best_step"), F.min(metric).alias("best"), F.avg(seconds).alias("mean_seconds"))


def model_delta(a: DataFrame, b: DataFrame, key: str, metric: str = "mae") -> DataFrame:
    """(key, a, b, delta, percent) for the keys of both."""
    out = a.select(key, F.col(metric).alias("a")).join(b.select(key, F.col(metric).alias("b")), key)
    return out.withColumn("delta", F.col("b") - F.col("a")).withColumn("percent", F.try_divide((F.col("b") - F.col("a")) * 100.0, F.col("a")))


def prediction_table(df: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str], digits: int = 3) -> DataFrame:
    """Wide predictions, rounded."""
    return df.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col(kind) == k, F.col(value))), digits).alias(k) for k in kinds])


def prediction_summary(df: DataFrame, kind: str, value: str) -> DataFrame:
    return df.groupBy(kind).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def write_report(df: DataFrame, path: str, model: str, fold: int, made_at: str) -> None:
    """A metric table with where it comes from, as JSON lines."""
    df.withColumns({"model": F.lit(model), "fold": F.lit(fold), "made_at": F.lit(made_at)}).write.mode("overwrite").json(path)
