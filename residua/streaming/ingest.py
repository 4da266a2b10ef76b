"""Incremental ingest: each landed file is taken once, with an audit of every batch; entries with versions and a redo of broken ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from residua.ship import shipped


def incremental_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, fmt: str = "json") -> DataFrame:
    """Append all files that earlier calls have not taken, then stop; returns the audit of all batches so far.

    Rows that do not parse go to ``sink``/corrupt. The checkpoint remembers files and batches, so a call that failed is
    taken up where it was; a batch that runs twice overwrites its own partition and nothing else.
    """
    bad = "_corrupt_record"
    reader = spark.readStream.format(fmt).schema(f"{schema}, {bad} string")
    rows = (reader.option("columnNameOfCorruptRecord", bad) if fmt in ("json", "csv") else reader).load(source)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number).cast("long"))
        batch.persist()
        try:
            save = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/{name}")
            save(batch.where(F.col(bad).isNull()).drop(bad), "rows")
            save(batch.where(F.col(bad).isNotNull()).select(bad, "batch"), "corrupt")
            counts = batch.groupBy("batch").agg(F.count(F.when(F.col(bad).isNull(), 1)).alias("n_new"), F.count(bad).alias("n_corrupt"))
            save(counts, "audit")
        finally:
            batch.unpersist()

    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("n_new long, n_corrupt long, batch long").parquet(f"{sink}/audit")


#: What a landing of an entry can be. Of these, NEW, CHANGED and REDONE make a version.
NEW, CHANGED, REDONE, SAME, CORRUPT = "new", "changed", "redone", "same", "corrupt"
_LANDING = "entry string, status string, version int, doc string, reached long"


def judge_landings(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The landings of one entry, in order of their time, against what has been kept of it: the digest of its last good document, how many versions it has had, and
    whether its last landing was broken. Only these three values are kept, however often an entry lands."""
    digest, version, broken = state.get if state.exists else (None, 0, False)
    landed = pd.concat(list(frames)).sort_values(["reached", "digest"], kind="stable", na_position="first")
    out = []
    for doc, own, reached in zip(landed["doc"], landed["digest"], landed["reached"], strict=True):
        if own is None:
            out.append((key[0], CORRUPT, version, None, reached))
            broken = True
            continue
        status = (REDONE if broken else NEW) if digest is None else SAME if own == digest else REDONE if broken else CHANGED
        if status != SAME:
            version += 1
        out.append((key[0], status, version, None if status == SAME else doc, reached))
        digest, broken = own, False
    state.update((digest, version, broken))
    yield pd.DataFrame(out, columns=["entry", "status", "version", "doc", "reached"])


def ingest_entries(spark: SparkSession, source: str, sink: str, checkpoint: str) -> DataFrame:
    """Take all landed entries that earlier calls have not, then stop; returns every landing so far: (entry, status, version, doc, reached).

    Landed files are JSON lines (entry, doc, reached): the entry's id, its document as text, and when it landed. A document that is no JSON is ``corrupt``: it makes no
    version and is waited for again, and the good one that follows is ``redone``; the first good one is ``new``, the same text once more is ``same``
    and makes no version, another text is ``changed``. State is kept for each entry in the stream's checkpoint, so a landing in a later call, or after a failure, is
    judged as if all had come at once. A batch that runs twice overwrites its own partition. Lines without an entry are left out; a null document is corrupt.
    """
    shipped(spark)
    rows = spark.readStream.schema("entry string, doc string, reached long").json(source).where("entry is not null")
    good = F.try_parse_json("doc").isNotNull()
    rows = rows.select("entry", F.when(good, F.col("doc")).alias("doc"), F.when(good, F.sha2("doc", 256)).alias("digest"), F.coalesce("reached", F.lit(0)).alias("reached"))
    judged = rows.groupBy("entry").applyInPandasWithState(judge_landings, _LANDING, "digest string, version int, broken boolean", "append", GroupStateTimeout.NoTimeout)

    def take(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/landings")

    query = judged.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{_LANDING}, batch long").parquet(f"{sink}/landings").drop("batch")


def current_entries(landings: DataFrame) -> DataFrame:
    """(entry, version, doc): the last version of each entry that has a good one."""
    made = landings.where(F.col("status").isin(NEW, CHANGED, REDONE))
    return made.groupBy("entry").agg(F.max("version").alias("version"), F.max_by("doc", "version").alias("doc"))
