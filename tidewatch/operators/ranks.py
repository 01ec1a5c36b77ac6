"""Ranks, running sums and exact quantiles over groups of any size, without one window per group.

Rows are range-partitioned by (group, order), in as many parts as their number asks for, and written once with their part; a window then spans
the rows of one group in one part, and what comes before is carried over by one row per group and part. So a
class, stratum or key that holds a third of the table is spread over as many tasks as it has parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stored

PART = "_part"
#: Rows of a part in the mean, at most.
PART_ROWS = 5_000_000


def in_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], part_rows: int | None = None) -> DataFrame:
    """`df` with its `_part`: parts follow each other in (by, order), as many as the session's shuffle partitions, or more where
    these would hold over `part_rows` (PART_ROWS) rows each. So a part fits a task whatever the size of the table; the rows are
    counted first, which reads no column that the count does not need."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / (part_rows or PART_ROWS)))
    return stored(df.repartitionByRange(parts, *by, *order).withColumn(PART, F.spark_partition_id()), "ranks")


def carried(placed: DataFrame, by: Sequence[str], aggregate: Column, name: str, merge=F.sum) -> DataFrame:
    """`placed` with `name`: `merge` of the aggregates of the group's earlier parts; null in its first one.

    Parts follow each other in order, so only the first group of a part has earlier parts: what is carried over is at most one
    row a part, which is broadcast, and the rows stay where they are."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    per = placed.groupBy(*by, PART).agg(aggregate.alias("_own"))
    per = per.withColumns({name: merge("_own").over(before), "_nth": F.row_number().over(Window.partitionBy(*by).orderBy(PART))}).where("_nth > 1")
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(PART).alias("_of"), name)
    same = F.col(PART) == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(F.broadcast(per), same, "left").drop("_of", *[f"_by_{c}" for c in by])


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, weight: str | None = None) -> DataFrame:
    """`df` with `name`: the sum of `weight` (rows, without one) over the group's rows up to and with this one, by a total order."""
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    placed = carried(in_parts(df, by, order), by, F.sum(amount), "_before")
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum(amount).over(inside)).drop("_before", PART)


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str, rows: str | None = None) -> DataFrame:
    """`df` with `rank` (from 1 in its group) and, if named, the group's number of `rows`."""
    ranked = with_running(df, by, order, rank)
    if rows is None:
        return ranked
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(rows)).select(*[F.col(c).alias(f"_by_{c}") for c in by], rows)
    if not by:
        return ranked.crossJoin(F.broadcast(counts))  # one row
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return ranked.join(counts, same).drop(*[f"_by_{c}" for c in by])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """(by.., name): the exact quantiles of the non-null values of each group, interpolated between neighbours.

    Over distinct values with their counts, which are far fewer than the rows where values repeat."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = with_running(per, by, [F.col("_v").asc()], "_upto", "_c")
    totals = per.groupBy(*by).agg(F.sum("_c").alias("_n")).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    run = run.join(totals, same) if by else run.crossJoin(F.broadcast(totals))
    found = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("_n") - 1)
        for end, row in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.min(F.when(F.col("_upto") > row, F.col("_v"))).alias(f"_{end}{i}"))
        found.append(F.first(at - F.floor(at)).alias(f"_rest{i}"))
    out = run.groupBy(*by).agg(*found)
    return out.select(*by, F.array(*[F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_rest{i}") for i in range(len(shares))]).alias(name))
