"""Normalisation statistics and their use: global and by group, train-only, fixed constants, forth and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import constants as C
from residua.scratch import beside


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "col", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def norm_stats(df: DataFrame, col: str, value: str, group: str | None = None, min_n: int = 10, floor: float = 0.1) -> DataFrame:
    """(scope, group, col, n, mean, std) of a long table, global and by group in one pass.

    A group counts with ``min_n`` values or more; spreads are sample deviations of at least ``floor``; a column
    without values has mean 0 and std 1 globally.
    """
    if group is None:
        df, group = df.withColumn("__g", F.lit(None).cast("string")), "__g"
    g = df.select(F.col(group).alias("group"), F.col(col).alias("col"), F.col(value).alias("v"))
    # every input row goes to the global and to its group's set; partial sums meet in one shuffle
    sets = g.groupingSets([["col"], ["group", "col"]], "group", "col").agg(
        F.grouping("group").alias("is_global"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    kept = sets.where((F.col("is_global") == 1) | ((F.col("n") >= min_n) & F.col("group").isNotNull()))
    return kept.select(
        F.when(F.col("is_global") == 1, "global").otherwise("group").alias("scope"),
        "group",
        "col",
        "n",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.greatest(F.coalesce("std", F.lit(floor)), F.lit(floor))).alias("std"),
    )


def train_only_stats(df: DataFrame, col: str, value: str, fold: str, folds: list[int], never: tuple[int, ...] = (0, 6), floor: float = 0.1) -> DataFrame:
    """(held_out, col, n, mean, std): for each held-out fold the statistics of all other folds but ``never``.

    One pass gives each fold its moments (count, mean, sum of squared differences); those of the other folds are then merged pairwise, which needs no
    row twice and loses no digits to subtraction.
    """
    used = df.where(~F.col(fold).isin(list(never)))
    v = F.col(value).cast("double")
    per = used.groupBy(F.col(fold).alias("fold"), F.col(col).alias("col")).agg(F.count(v).cast("double").alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("off"))
    held = F.explode(F.filter(F.array(*[F.lit(k) for k in folds]), lambda k: k != F.col("fold"))).alias("held_out")
    # a row for each fold and column, and as many held-out folds
    sets = per.select(held, "col", F.struct("fold", "n", "mean", "off").alias("m")).groupBy("held_out", "col").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def merged(x: Column, y: Column) -> Column:
        n = x["n"] + y["n"]
        part = F.when(n > 0, y["n"] / n).otherwise(0.0)
        apart = y["mean"] - x["mean"]
        return F.struct(n.alias("n"), (x["mean"] + apart * part).alias("mean"), (x["off"] + y["off"] + apart * apart * x["n"] * part).alias("off"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("off"))
    whole = sets.select("held_out", "col", F.aggregate("ms", zero, merged).alias("m"))
    std = F.when(F.col("m.n") > 1, F.sqrt(F.col("m.off") / (F.col("m.n") - 1)))
    return whole.select("held_out", "col", F.col("m.n").cast("long").alias("n"), F.col("m.mean").alias("mean"), F.when(F.col("m.n") == 0, 1.0).otherwise(F.greatest(F.coalesce(std, F.lit(floor)), F.lit(floor))).alias("std"))


def require_same_columns(given: DataFrame, cols: list[str]) -> DataFrame:
    """A given table of statistics, if it is for exactly these columns."""
    have = sorted(r[0] for r in given.where("scope = 'global'").select("col").distinct().limit(len(cols) + 1).collect())
    if have != sorted(cols):
        raise ValueError(f"statistics are for {have}, not for {sorted(cols)}")
    return given


def zscore(df: DataFrame, stats: DataFrame, on: list[str], value: str, out: str = "z", least_std: float = 1e-6, clip: float | None = 10.0) -> DataFrame:
    """(value - mean) / std, or value - mean where the spread is next to none; null without statistics."""
    z = F.col(value) - F.col("mean")
    z = F.when(F.col("std") > least_std, z / F.col("std")).otherwise(z)
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    joined = df.join(beside(stats.select(*on, "mean", "std")), on, "left")
    return joined.withColumn(out, F.when(F.col(value).isNotNull() & F.col("mean").isNotNull(), z)).drop("mean", "std")


def _both_scopes(df: DataFrame, stats: DataFrame, col: str, group: str, floor: float) -> DataFrame:
    g = stats.where("scope = 'group'").select(F.col("group").alias("__g"), F.col("col").alias("__c"), F.col("mean").alias("__gm"), F.col("std").alias("__gs"))
    a = stats.where("scope = 'global'").select(F.col("col").alias("__a"), F.col("mean").alias("__am"), F.col("std").alias("__as"))
    out = df.join(beside(g), (df[group] == F.col("__g")) & (df[col] == F.col("__c")), "left").join(beside(a), df[col] == F.col("__a"), "left")
    mean = F.coalesce("__gm", "__am", F.lit(0.0))
    std = F.greatest(F.coalesce("__gs", "__as", F.lit(1.0)), F.lit(floor))
    return out.withColumn("__mean", mean).withColumn("__std", std)


def normalise(df: DataFrame, stats: DataFrame, col: str, group: str, value: str, out: str = "z", floor: float = 0.1) -> DataFrame:
    """By the group's statistics, else the global ones, else (0, 1); one floor for both directions."""
    return _both_scopes(df, stats, col, group, floor).withColumn(out, (F.col(value) - F.col("__mean")) / F.col("__std")).select(*df.columns, out)


def denormalise(df: DataFrame, stats: DataFrame, col: str, group: str, z: str, out: str = "value", floor: float = 0.1) -> DataFrame:
    return _both_scopes(df, stats, col, group, floor).withColumn(out, F.col(z) * F.col("__std") + F.col("__mean")).select(*[c for c in df.columns if c != out], out)


def renormalise(df: DataFrame, stats: DataFrame, col: str, group: str, z: str, out: str = "z_group", floor: float = 0.1) -> DataFrame:
    """Global z to raw values to group z."""
    own = _both_scopes(df, stats, col, group, floor)
    raw = F.col(z) * F.greatest(F.coalesce("__as", F.lit(1.0)), F.lit(floor)) + F.coalesce("__am", F.lit(0.0))
    return own.withColumn(out, (raw - F.col("__mean")) / F.col("__std")).select(*df.columns, out)


def lookup_first(df: DataFrame, table: DataFrame, group: str, name: str, values: list[str], aliases: DataFrame) -> DataFrame:
    """Values of (group, name) from a table, by the name itself or else by the first of its aliases that the group has.

    ``aliases`` is (name, alias, rank); ``table`` is (group, name, values). Unknown names give null.
    """
    names = df.select(name).distinct()
    tried = names.select(name, F.col(name).alias("__alias"), F.lit(0).alias("__rank")).unionByName(
        names.join(beside(aliases.select(F.col(name), F.col("alias").alias("__alias"), F.col("rank").alias("__rank"))), name)
    )
    t = table.select(F.col(group), F.col(name).alias("__alias"), F.struct(*values).alias("__v"))
    best = tried.join(beside(t), "__alias").groupBy(group, name).agg(F.min_by("__v", "__rank").alias("__v"))
    return df.join(beside(best), [group, name], "left").select(*df.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def transfer_correct(df: DataFrame, base: DataFrame, source: str, target: str, atom: str, value: str, out: str = "corrected") -> DataFrame:
    """A value measured on ``source`` moved to ``target`` by the difference of their base values for the atom; unchanged
    where either is missing. ``base`` is (residue, atom, shift)."""
    s = base.select(F.col("residue").alias(source), F.col("atom").alias(atom), F.col("shift").alias("__s"))
    t = base.select(F.col("residue").alias(target), F.col("atom").alias(atom), F.col("shift").alias("__t"))
    joined = df.join(beside(s), [source, atom], "left").join(beside(t), [target, atom], "left")
    return joined.withColumn(out, F.coalesce(F.col("__t") + (F.col(value) - F.col("__s")), F.col(value))).select(*df.columns, out)


def secondary_shift(df: DataFrame, base: DataFrame, residue: str, atom: str, value: str, out: str = "secondary") -> DataFrame:
    b = base.select(F.col("residue").alias(residue), F.col("atom").alias(atom), F.col("shift").alias("__b"))
    return df.join(beside(b), [residue, atom], "left").withColumn(out, F.col(value) - F.col("__b")).drop("__b")


def read_constants(spark: SparkSession, path: str) -> DataFrame:
    """(residue, atom, center, scale) from CSV files with that header, names in upper case; rows without residue, atom or any number are left out. The first row
    by its values stands where a residue and atom come twice."""
    raw = spark.read.csv(path, header=True, schema="residue string, atom string, center double, scale double", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.select(F.upper("residue").alias("residue"), F.upper("atom").alias("atom"), "center", "scale").where("residue is not null and atom is not null and (center is not null or scale is not null)")
    return rows.groupBy("residue", "atom").agg(F.min(F.struct("center", "scale")).alias("v")).select("residue", "atom", "v.center", "v.scale")


def fixed_stats(stats: DataFrame, constants: DataFrame, base: DataFrame, residues: list[str], cols: list[str], marker: str, suffix: str = "_shift", floor: float = 0.1) -> DataFrame:
    """``stats`` (scope, group, col, n, mean, std) with fixed values in place of the group rows, and a column ``normalization`` that says which.

    A column's atom is its name without ``suffix``. Center: the base value (residue, atom, shift) if there is one, else that of ``constants`` (residue, atom,
    center, scale), by the atom or the first of its pooled methyl names that the residue has. Scale: that of ``constants``. What is missing is the
    column's global value, else 0 and 1; scales are ``floor`` at least. The fixed rows have no n. The global rows stay as they are.
    """
    spark = stats.sparkSession
    wanted = [(r, c, atom) for r in residues for c in cols for atom in [c.removesuffix(suffix).upper()]]
    known = spark.createDataFrame(wanted, "residue string, col string, atom string")
    aliases = spark.createDataFrame([(a, m, i) for a, ms in C.METHYL_ALIASES.items() for i, m in enumerate(ms, 1)], "atom string, alias string, rank int")
    found = lookup_first(known, constants, "residue", "atom", ["center", "scale"], aliases)
    found = found.join(beside(base.select("residue", "atom", "shift")), ["residue", "atom"], "left")
    every = stats.where("scope = 'global'").select("col", F.col("mean").alias("__m"), F.col("std").alias("__s"))
    found = found.join(beside(every), "col", "left")
    mean = F.coalesce("shift", "center", "__m", F.lit(0.0))
    std = F.greatest(F.coalesce("scale", "__s", F.lit(1.0)), F.lit(floor))
    rows = found.select(F.lit("group").alias("scope"), F.col("residue").alias("group"), "col", F.lit(None).cast("long").alias("n"), mean.alias("mean"), std.alias("std"))
    return stats.where("scope = 'global'").select("scope", "group", "col", "n", "mean", "std").unionByName(rows).withColumn("normalization", F.lit(marker))
