"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from residua.llm import words as W

RING = 1 << 32
#: The ring is also cut into equal cells, so that keys are ranked in small groups: so many bits of cells at least and at most, and so many rows in a cell between.
LEAST_CELL_BITS, MOST_CELL_BITS, CELL_ROWS = 14, 20, 20_000
#: A ring position with so many rows (or eight times a cell's mean, if that is more) is ranked in parts of ``CELL_ROWS`` or so.
HOT_ROWS = 100_000


def ring_position(key: Column) -> Column:
    """Where a key stands on the ring, 0 to 2**32 - 1; null stands where the empty string does."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def virtual_nodes(shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted((int(hashlib.md5(f"shard-{s}-{i}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for i in range(per_shard))


def clockwise(nodes: list[tuple[int, int]], at: int, shards: int) -> list[int]:
    """The shards in the order in which a walk clockwise from a position meets them."""
    begin, seen = bisect_left(nodes, (at, -1)), []
    for k in range(len(nodes)):
        s = nodes[(begin + k) % len(nodes)][1]
        if s not in seen:
            seen.append(s)
            if len(seen) == shards:
                break
    return seen


def allot(counts: list[tuple[int, int, int]], nodes: list[tuple[int, int]], shards: int, capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, first rank, end rank, shard, first slot): which shard takes which ranks of each part of a cell.

    ``counts`` has (last ring position of a cell, part of it, rows in that). In each round the rows not yet placed knock at the
    next shard of their clockwise walk; a shard takes them in ring order until it is full, the rest walk on. Every
    round with rows left fills a shard, so there are at most as many rounds as shards.
    """
    first = {cell: bisect_left(nodes, (cell, -1)) for cell, _, _ in counts}
    walks = {i: clockwise(nodes, nodes[i % len(nodes)][0], shards) for i in set(first.values())}
    left = {(cell, part): n for cell, part, n in counts}
    rank, turn = dict.fromkeys(left, 0), dict.fromkeys(left, 0)
    room, slot, out = list(capacity), [0] * shards, []
    waiting = sorted(at for at, n in left.items() if n)
    while waiting:
        again = []
        for at in waiting:
            s = walks[first[at[0]]][turn[at]]
            if take := min(room[s], left[at]):
                out.append((*at, rank[at], rank[at] + take, s, slot[s]))
                room[s] -= take
                slot[s] += take
                rank[at] += take
                left[at] -= take
            if left[at]:
                turn[at] += 1
                again.append(at)
        waiting = again
    return out


def ring_shards(df: DataFrame, key: str, shards: int, per_shard: int = 64, slack: float = 0.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    A key goes to the first virtual node clockwise from its hash; a shard takes at most its share of the rows times
    1 + ``slack`` (with 0, counts differ by one at most), and keys that find it full continue clockwise. Only row
    counts of the ring's cells come to the driver: at most 2**``MOST_CELL_BITS`` + ``shards`` x ``per_shard`` numbers, whatever
    the input. Rows are then ranked inside their cell (one shuffle) and find their shard by a broadcast of that
    bounded plan. ``ties`` are columns that order rows of one key; rows equal in all of them are interchangeable. The rows of a
    key that has very many are ranked in parts, dealt by a hash of key and ties, so only rows equal in all of these are sure to share a task. A null key is the empty string's; an empty table gives an empty result; very long texts are only carried along;
    columns ``shard`` and ``slot`` of ``df`` are replaced, its others may have any name.
    """
    df = df.drop("shard", "slot")
    tag = W.free_prefix(df.columns)
    pos, cell, at, edges, rank, p, part = (tag + x for x in ("pos", "cell", "grid", "edges", "rank", "plan", "part"))
    spark = df.sparkSession
    nodes = virtual_nodes(shards, per_shard)
    n = df.count()
    bits = min(MOST_CELL_BITS, max(LEAST_CELL_BITS, (n // CELL_ROWS).bit_length()))
    low = 32 - bits
    # a cell is named by its last position: the nearest edge clockwise of the uniform grid or of the virtual nodes
    inner: dict[int, set[int]] = {}
    for q, _ in nodes:
        inner.setdefault(q >> low, set()).add(q)
    own = df.withColumn(pos, ring_position(F.col(key)))

    def placed(parts: dict[int, int]) -> DataFrame:
        grid = spark.createDataFrame([(c, sorted(q)) for c, q in inner.items()], f"{at} long, {edges} array<long>")
        out = own.withColumn(at, F.shiftright(pos, low)).join(F.broadcast(grid), at, "left")
        out = out.withColumn(cell, F.coalesce(F.get(F.filter(edges, lambda e: e >= F.col(pos)), 0), F.shiftleft(F.col(at) + 1, low) - 1)).drop(at, edges)
        if not parts:
            return out.withColumn(part, F.lit(0))
        cuts = F.broadcast(spark.createDataFrame(list(parts.items()), f"{cell} long, {p} int"))
        return out.join(cuts, cell, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(key, *ties), F.col(p)), F.lit(0)).cast("int")).drop(p)

    def counted(rows: DataFrame) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in rows.groupBy(cell, part).count().collect()]

    rows = placed({})
    counts = counted(rows)
    hot = max(HOT_ROWS, 8 * n >> bits)
    if crowded := [(c,) for c, _, k in counts if k > hot]:
        met = rows.join(F.broadcast(spark.createDataFrame(crowded, f"{cell} long")), cell).groupBy(pos).count().where(F.col("count") > hot // 2)
        parts = {r[0]: -(-r[1] // CELL_ROWS) for r in met.collect()}
        for q in parts:  # each such position becomes a cell of its own
            inner.setdefault(q >> low, set()).update(x for x in (q - 1, q) if x >> low == q >> low)
        rows = placed(parts)
        counts = counted(rows)
    if slack:
        capacity = [-(-int(n * (1 + slack) + 1) // shards)] * shards
    else:
        capacity = [n // shards + (s < n % shards) for s in range(shards)]
    plan = spark.createDataFrame(allot(counts, nodes, shards, capacity), f"{cell} long, {part} int, first long, last long, shard int, slot long")
    plan = plan.groupBy(cell, part).agg(F.collect_list(F.struct("first", "last", "shard", "slot")).alias(p))
    order = Window.partitionBy(cell, part).orderBy(pos, key, *ties)
    found = rows.withColumn(rank, F.row_number().over(order).cast("long") - 1).join(F.broadcast(plan), [cell, part])
    found = found.withColumn(p, F.get(F.filter(p, lambda z: (z["first"] <= F.col(rank)) & (F.col(rank) < z["last"])), 0))
    return found.select(*df.columns, F.col(p)["shard"].alias("shard"), (F.col(p)["slot"] + F.col(rank) - F.col(p)["first"]).alias("slot"))
