"""Ordered positions: windows by position value, neighbours, adjacency, spans, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.scratch import written


#: Positions in a stretch. An entity is dealt to tasks by stretches, so one of any length is spread over all of them.
STRETCH = 1 << 16


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name = "_" + name
    return name


def _stretch(pos: Column) -> Column:
    return F.floor(pos / STRETCH)


def _with_halo(df: DataFrame, pos: str, reach: int) -> tuple[DataFrame, str, Column]:
    """``df`` with its rows' stretches in a column of the second value's name: its own, and each other one from which its position can be seen over ``reach`` positions. The third
    value says whether a row stands in its own. Null positions are one stretch."""
    name = _free(df.columns, "stretch")
    p = F.col(pos)
    seen = F.explode_outer(F.sequence(_stretch(p - reach), _stretch(p + reach)))
    return df.withColumn(name, seen), name, F.col(name).eqNullSafe(_stretch(p))


def window_context(df: DataFrame, entity: str, pos: str, cols: list[str], w: int = 5) -> DataFrame:
    """``df`` with ``context``: structs (offset, cols) of the rows at pos - w to pos + w, by position value.

    Positions that are missing leave a gap, and nothing crosses an entity. Positions must be unique in an entity.
    One shuffle, on the entity and the stretch of positions; rows within ``w`` of a stretch's border stand in both as a halo.
    """
    spread, stretch, own = _with_halo(df, pos, w)
    frame = Window.partitionBy(entity, stretch).orderBy(F.col(pos).cast("long")).rangeBetween(-w, w)
    near = F.collect_list(F.struct(F.col(pos), *cols)).over(frame)
    p = F.col(pos)
    context = F.transform("context", lambda z: F.struct((z[pos] - p).cast("int").alias("offset"), *[z[c].alias(c) for c in cols]))
    return spread.withColumn("context", near).where(own).drop(stretch).withColumn("context", context)


def neighbour_gather(df: DataFrame, neighbours: DataFrame, entity: str, pos: str, cols: list[str]) -> DataFrame:
    """(entity, pos, slot, neighbour, cols, valid): neighbours' columns by equality on (entity, position)."""
    src = df.select(entity, F.col(pos).alias("neighbour"), *cols, F.lit(True).alias("valid"))
    return neighbours.join(src.hint("merge"), [entity, "neighbour"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def adjacent(df: DataFrame, entity: str, pos: str, expr, mode: str = "true") -> DataFrame:
    """``df`` with the columns that ``expr(before, after)`` gives, where both are functions from a column name to the
    value in the row before or after: the next row (mode ``row``), or the next only if its position differs by 1.

    Stretches of an entity are dealt to tasks: in mode ``true`` with the rows beside their borders, in mode ``row`` with the last row before and
    the first row after them, which come from one row for each stretch.
    """
    if mode == "row":
        spread, stretch = df, _free(df.columns, "stretch")
        spread = written(df.withColumn(stretch, _stretch(F.col(pos))), "stretches")
        ends = spread.groupBy(entity, stretch).agg(F.max_by(F.struct(*df.columns), F.col(pos)).alias("last"), F.min_by(F.struct(*df.columns), F.col(pos)).alias("first"))
        beyond = Window.partitionBy(entity).orderBy(stretch)
        ends = ends.select(F.col(entity).alias("__e"), F.col(stretch).alias("__s"), F.lag("last").over(beyond).alias("__before"), F.lead("first").over(beyond).alias("__after"))
        spread = spread.join(ends.hint("merge"), spread[entity].eqNullSafe(F.col("__e")) & spread[stretch].eqNullSafe(F.col("__s"))).drop("__e", "__s")
        own, extra = F.lit(True), [stretch, "__before", "__after"]
    else:
        spread, stretch, own = _with_halo(df, pos, 1)
        extra = [stretch]
    w = Window.partitionBy(entity, stretch).orderBy(pos)
    inside = {F.lag: F.row_number().over(w) > 1, F.lead: F.row_number().over(Window.partitionBy(entity, stretch).orderBy(F.desc(pos))) > 1}

    def beside(step, sign: int, border: str):
        def get(c: str) -> Column:
            v = step(F.col(c)).over(w)
            if mode == "row":
                return F.when(inside[step], v).otherwise(F.col(border)[c])
            return F.when(step(F.col(pos)).over(w) == F.col(pos) + sign, v)

        return get

    return spread.withColumns(expr(beside(F.lag, -1, "__before"), beside(F.lead, 1, "__after"))).where(own).drop(*extra)


def distance(a: list[Column], b: list[Column]) -> Column:
    total = sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))
    return F.sqrt(total)


def adjacent_geometry(df: DataFrame, entity: str, pos: str, mode: str = "true") -> DataFrame:
    """Four lengths to the neighbours in sequence from columns ca_x.., c_x.., n_x..: CA to CA both ways, C to next N and
    previous C to N."""
    at = lambda get, a: [get(f"{a}_{k}") for k in "xyz"]

    def expr(before, after):
        return {
            "bond_ca_prev": distance(at(F.col, "ca"), at(before, "ca")),
            "bond_ca_next": distance(at(F.col, "ca"), at(after, "ca")),
            "bond_peptide_fwd": distance(at(F.col, "c"), at(after, "n")),
            "bond_peptide_bkwd": distance(at(before, "c"), at(F.col, "n")),
        }

    return adjacent(df, entity, pos, expr, mode)


def edge_flag(df: DataFrame, entity: str, pos: str, edge: int = 2) -> DataFrame:
    """``is_edge``: among the first or last ``edge`` rows of the entity. Rows are numbered inside their stretch of positions; the rows of an entity's other stretches come from
    one number for each."""
    stretch = _free(df.columns, "stretch")
    rows = written(df.withColumn(stretch, _stretch(F.col(pos))), "stretches")
    counts = rows.groupBy(entity, stretch).agg(F.count("*").alias("__k"))
    before = Window.partitionBy(entity).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(entity).alias("__e"), F.col(stretch).alias("__s"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"), F.sum("__k").over(Window.partitionBy(entity)).alias("__n"))
    both = rows.join(counts.hint("merge"), rows[entity].eqNullSafe(F.col("__e")) & rows[stretch].eqNullSafe(F.col("__s"))).drop("__e", "__s")
    i = F.row_number().over(Window.partitionBy(entity, stretch).orderBy(pos)) + F.col("__before")
    return both.withColumn("__i", i).withColumn("is_edge", (F.col("__i") <= edge) | (F.col("__i") > F.col("__n") - edge)).drop("__i", "__n", "__before", stretch)


def entity_span(df: DataFrame, entity: str, pos: str) -> DataFrame:
    """(entity, first, last, n, n_gaps) of each entity's positions."""
    return df.groupBy(entity).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count_distinct(pos).alias("n")).withColumn("n_gaps", F.col("last") - F.col("first") + 1 - F.col("n"))


def sample_index(df: DataFrame, cols: list[str], after_mask: bool = False) -> DataFrame:
    """Rows with at least one observed target; with ``after_mask``, only targets whose mask is set count."""
    seen = [F.col(f"{c}__mask") if after_mask else F.col(c).isNotNull() for c in cols]
    return df.where(F.greatest(*[s.cast("int") for s in seen]) == 1 if len(seen) > 1 else seen[0])


def loo_split(df: DataFrame, fold: str, k: int, folds: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Rows of the cross-validation folds tagged ``part``: test for fold k, train for the others."""
    return df.where(F.col(fold).isin(list(folds))).withColumn("part", F.when(F.col(fold) == k, "test").otherwise("train"))


def impute_samples(df: DataFrame, entity: str, pos: str, cols: list[str], w: int = 5, neighbours: DataFrame | None = None) -> DataFrame:
    """One row for each observed target: (entity, pos, nucleus, target, context) and, with ``neighbours`` (entity, pos, slot, neighbour), ``near``.

    The context has every target of the rows around, but the sample's own target is hidden at offset 0. ``near`` has the spatial neighbours in the order of their
    slots, with all their targets unmasked and whether they exist; null for positions without neighbours. The window and the neighbours are
    gathered once for each row, before the targets are unpivoted.
    """
    own = df.select(entity, pos, *cols)
    ctx = window_context(own, entity, pos, cols, w)
    extra = []
    if neighbours is not None:
        met = neighbour_gather(own, neighbours.select(entity, F.col("pos").alias(pos), "slot", "neighbour"), entity, pos, cols)
        near = met.groupBy(entity, pos).agg(F.array_sort(F.collect_list(F.struct("slot", "neighbour", *cols, "valid"))).alias("near"))
        ctx, extra = ctx.join(near.hint("merge"), [entity, pos], "left"), ["near"]
    cells = F.array(*[F.struct(F.lit(c).alias("nucleus"), F.col(c).alias("target")) for c in cols])
    rows = ctx.select(entity, pos, "context", *extra, F.explode(F.filter(cells, lambda z: z["target"].isNotNull())).alias("z")).select(entity, pos, "context", *extra, "z.nucleus", "z.target")
    nucleus = F.col("nucleus")
    hidden = F.transform("context", lambda z: F.struct(z["offset"].alias("offset"), *[F.when((z["offset"] == 0) & (nucleus == c), None).otherwise(z[c]).alias(c) for c in cols]))
    return rows.withColumn("context", hidden)
