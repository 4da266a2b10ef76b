"""Intermediate tables in the folder that every machine of the cluster can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset (a local session)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_residua_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._residua_scratch = own
    return own


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage is cut, its size is known to the planner,
    and no later read depends on an executor that may be lost. Nothing deletes the table, since lazy results may still read it;
    whoever owns the folder in ``spark.checkpoint.dir`` clears it between jobs."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` written and marked as the small side of a join: broadcast if a count shows at most ``most`` rows (of a few numbers and names each), else for a sort-merge join."""
    own = written(df, "beside")
    return F.broadcast(own) if own.count() <= most else own.hint("merge")
