"""Rows numbered in order within groups of any size: a group may fill many range partitions, and no task holds one."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], range_by: list[str] | None = None) -> DataFrame:
    """df with place (long: each row's number, from 0, in its group by order, ascending, nulls first), and with each of sums over
    the rows of the group before it (long).

    Rows are dealt by ranges of range_by (else of group and order: name it where order has long texts, as its values are
    sampled), sorted and written once. Of a group there are as many stretches as partitions that hold it; a row's number and
    sums are those in its stretch plus those of the stretches before. Rows equal in range_by share a partition.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *(range_by or [*group, *order])).sortWithinPartitions(*group, *order)
    added = {f"_sum_{n}": c.cast("long") for n, c in sums.items()}
    rows = written(dealt.withColumns(added | {"_at": F.monotonically_increasing_id()}), "numbered")
    run = F.shiftright("_at", 33)
    totals = rows.groupBy(*group, run.alias("_run")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"), *(F.sum(c).alias(f"{c}_all") for c in added))
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    shifts = totals.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(group)), "_run", (before("_n") - F.col("_low")).alias("_shift"), *(before(f"{c}_all").alias(f"{c}_before") for c in added))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(group)), run == F.col("_run"))
    inside = Window.partitionBy(*group, run).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in added}) if added else rows
    return rows.join(shifts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("place"), *((F.col(f"_sum_{n}_in") + F.col(f"_sum_{n}_before")).alias(n) for n in sums))


def numbered(df: DataFrame, group: list[str], order: list[str], range_by: list[str] | None = None) -> DataFrame:
    """df with place, as running() gives it."""
    return running(df, group, order, {}, range_by)
