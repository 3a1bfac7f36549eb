"""Helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a dimension that is sent to every task.
FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df marked for broadcast if it is counted to have no more than `most` rows, else df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
