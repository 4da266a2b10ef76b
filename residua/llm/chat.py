"""Reply trees to chat transcripts: root-to-leaf paths by iterative self-joins, ranked and formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.scratch import written

#: The template's control strings. A turn reads <s>[ROLE]role[/ROLE]text</s>.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
_TAIL = r"(?=/?s>|/?INST\]|/?ROLE\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    r"""One backslash more between a control string's bracket and the rest; texts without any stay as they are.
    ``[INST]`` becomes ``[\INST]``, ``[\INST]`` becomes ``[\\INST]``, so that ``unescape`` gives back every text."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _TAIL, "$1$2")


def reply_paths(nodes: DataFrame, tree: str, node: str, parent: str, score: str, top: int | None = None) -> DataFrame:
    """(tree, leaf, path_rank, path_score, depth, node): the nodes of every root-to-leaf path, or of a tree's ``top``
    best, depth 0 at the root.

    A path's score is the sum of its nodes' scores (null counts as 0); ranks are dense from 1, ties go to the smaller leaf.
    Paths are enumerated by self-joins with doubling strides: first the table of 2**k-th ancestors with the score
    gathered on the way, then, from the longest stride down, each known place on a path adds the place one stride
    above. That takes twice log2(depth) joins on (tree, node), whose keys are unique, so a giant tree is no skew, and
    no more rows than the result has. A node whose parent is null or absent is a root. Repeated (tree, node) rows
    count once (smallest parent, largest score). Nodes on a cycle are on no root-to-leaf path. Null trees are one
    tree; a null node is nobody's parent. An empty table gives none; texts are not read here; other columns may have any name.
    """
    spark = nodes.sparkSession
    t, n, p = F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p")
    base = nodes.select(t, n, p, F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("w")).groupBy("t", "n").agg(F.min("p").alias("p"), F.max("w").alias("w"))
    known = base.select(F.col("t").alias("kt"), F.col("n").alias("kn")).where("n is not null")
    up = base.join(known.hint("merge"), F.col("t").eqNullSafe(F.col("kt")) & (F.col("p") == F.col("kn")), "left").select("t", "n", F.col("kn").alias("a"), "w")
    up = written(up, "ancestors")
    leaves = up.join(
        up.select(F.col("t").alias("kt"), F.col("a").alias("kn")).where("kn is not null").distinct().hint("merge"),
        F.col("t").eqNullSafe(F.col("kt")) & (F.col("n") == F.col("kn")),
        "left_anti",
    ).select("t", F.col("n").alias("leaf"))
    strides, total = [up], up.count()
    # doubling: a is the 2**k-th ancestor, w the score of the 2**k nodes from n upwards
    while (1 << len(strides)) <= 2 * total and (live := strides[-1].where("a is not null")).take(1):
        above = strides[-1].select(F.col("t").alias("kt"), F.col("n").alias("kn"), F.col("a").alias("ka"), F.col("w").alias("kw"))
        both = F.col("t").eqNullSafe(F.col("kt")) & (F.col("a") == F.col("kn"))
        live = live.join(above.hint("merge"), both, "left").select("t", "n", F.col("ka").alias("a"), (F.col("w") + F.coalesce("kw", F.lit(0.0))).alias("w"))
        strides.append(written(live.unionByName(strides[-1].where("a is null")), "ancestors"))
    # what still has an ancestor beyond any possible depth hangs on a cycle
    scores = strides[-1].where("a is null").select(F.col("t").alias("kt"), F.col("n").alias("kn"), F.col("w").alias("path_score"))
    ranked = leaves.join(scores.hint("merge"), F.col("t").eqNullSafe(F.col("kt")) & F.col("leaf").eqNullSafe(F.col("kn"))).select("t", "leaf", "path_score")
    ranked = ranked.withColumn("path_rank", F.row_number().over(Window.partitionBy("t").orderBy(F.col("path_score").desc(), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("path_rank") <= top)
    places = ranked.select("t", "leaf", "path_rank", "path_score", F.col("leaf").alias("n"), F.lit(0).cast("long").alias("up"))
    for k in range(len(strides) - 1, -1, -1):
        step = strides[k].where("a is not null").select(F.col("t").alias("kt"), F.col("n").alias("kn"), "a")
        higher = places.join(step.hint("merge"), F.col("t").eqNullSafe(F.col("kt")) & (F.col("n") == F.col("kn")))
        higher = higher.select("t", "leaf", "path_rank", "path_score", F.col("a").alias("n"), (F.col("up") + (1 << k)).alias("up"))
        places = written(places.unionByName(higher), "places")
    return places.select(F.col("t").alias(tree), "leaf", "path_rank", "path_score", F.col("n").alias(node), F.col("up"))


def format_paths(paths: DataFrame, nodes: DataFrame, tree: str, node: str, role: str, text: str, trained: str = "assistant") -> DataFrame:
    """One conversation for each path: (tree, leaf, path_rank, path_score, formatted, loss_spans).

    ``formatted`` has the path's turns from root to leaf, each <s>[ROLE]role[/ROLE]text</s> with control strings
    escaped; null role or text is empty, and of repeated (tree, node) rows the smallest role and text stand. Texts may be as long as a row can
    be; other columns may have any name. ``loss_spans`` has (start, length) in code points, start from 1, of the
    escaped text of every turn whose role is ``trained``.
    """
    own = nodes.select(F.col(tree).alias("kt"), F.col(node).alias("kn"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    own = own.groupBy("kt", "kn").agg(F.min(F.struct("r", "x")).alias("turn"))
    full = paths.join(own.hint("merge"), F.col(tree).eqNullSafe(F.col("kt")) & F.col(node).eqNullSafe(F.col("kn")))
    turn = F.struct((-F.col("up")).alias("at"), F.col("turn.r").alias("r"), escape(F.col("turn.r")).alias("er"), escape(F.col("turn.x")).alias("ex"))
    whole = full.groupBy(tree, "leaf", "path_rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    head = lambda z: F.concat(F.lit("<s>[ROLE]"), z["er"], F.lit("[/ROLE]"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("_turns", lambda z: F.concat(head(z), z["ex"], F.lit("</s>"))), ""))
    # positions from one pass: the running length is the last end of the spans so far
    zero = F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def add(acc: Column, z: Column) -> Column:
        begin, n = acc["at"] + F.length(head(z)), F.length(z["ex"]).cast("long")
        span = F.struct(begin.alias("start"), n.alias("length"))
        return F.struct((begin + n + 4).alias("at"), F.when(z["r"] == trained, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = whole.withColumn("loss_spans", F.aggregate("_turns", zero, add, lambda acc: acc["spans"]))
    return whole.drop("_turns")


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    bodies = F.filter(F.split(formatted, r"</s>", -1), lambda z: z != "")
    role = lambda z: F.regexp_extract(z, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)
    text = lambda z: F.regexp_extract(z, r"(?s)^<s>\[ROLE\].*?\[/ROLE\](.*)$", 1)
    return F.transform(bodies, lambda z: F.struct(unescape(role(z)).alias("role"), unescape(text(z)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int"))))
