"""Rows looked up in a dimension table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension goes to every executor.
BROADCAST_ROWS = 50_000


def lookup(df: DataFrame, key: Column, dimension: DataFrame, on: str, default: Any = None, fold_case: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with the columns of dimension's row whose column on equals key; no other row's: those of the row named by default,
    or nulls. on holds no value twice (fold_case: no two that differ in case alone).

    The dimension's rows are counted, up to most: that many are broadcast, and a larger one is joined by shuffle, where keys that
    it does not hold are left to Spark's split of skewed partitions.
    """
    folded = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    small = dimension.limit(most + 1).count() <= most
    side = dimension.withColumn("_on", folded(F.col(on)))
    side = F.broadcast(side) if small else side
    out = df.withColumn("_key", folded(key)).join(side, F.col("_key") == F.col("_on"), "left")
    if default is None:
        return out.drop("_key", "_on")
    row = dimension.where(F.col(on) == F.lit(default)).first()
    if row is None:
        raise ValueError(f"{on} never is {default!r}")
    filled = (F.when(F.col("_on").isNull(), F.lit(row[c]).cast(dimension.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in dimension.columns)
    return out.select(*df.columns, *filled)
