"""Batch scoring with a user's predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from residua.operators.stats import denormalise
from residua.ship import shipped


def score_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], stats: DataFrame | None = None, col: str | None = None, group: str | None = None, out: str = "predicted") -> DataFrame:
    """``df`` with ``out``: the predictor sees Arrow batches as pandas frames and gives one number for each row; with ``stats``
    its z values are brought back to raw ones by group (``col``, ``group``)."""
    shipped(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: predict(f).astype("float64")})

    kind = ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], f"`{out}` double"])
    scored = df.mapInPandas(run, kind)
    return scored if stats is None else denormalise(scored, stats, col, group, out, out)
