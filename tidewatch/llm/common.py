"""Shared pieces of the training-data operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut, shared_dir, stored  # noqa: F401  (re-exported)

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, rows: int = 1000) -> None:
    """From here on, Arrow batches of this session hold at most `rows` rows, if it has not set fewer: rows carry whole texts, and
    every running task holds a batch on both sides, the JVM's twice while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Words in a text as long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_offsets(df: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """Exclusive running sum of `value` in order of the unique integer `key` (0 .. rows-1), as `offset`.

    Two levels of about sqrt(rows) keep every window small: sums within a block, and block starts.
    """
    width = max(1, math.isqrt(max(1, rows)))
    blocked = df.withColumn("_block", F.floor(F.col(key) / width))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return (
        blocked.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(starts, "_block")
        .withColumn("offset", (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_block", "_within", "_start")
    )


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def usual_width(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(width, rows of it): the most frequent width of the vectors, the smaller of equally frequent ones; (0, 0) without rows."""
    found = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return (found[0]["width"], found[0]["count"]) if found else (0, 0)


def list_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one width, without nulls, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
