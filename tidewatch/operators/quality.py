"""Quality reports and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_report(routed: DataFrame, order: str, examples: int = 20) -> DataFrame:
    """One row: total, accepted, rejected, rate and the first rejected rows by `order`."""
    first = routed.where("not accepted").orderBy(order).limit(examples).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "rejected.field", "rejected.reason"))).alias("examples"))
    counts = routed.agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return counts.crossJoin(first).withColumn("rate", F.when(F.col("total") > 0, F.col("accepted") / F.col("total")))


def value_counts(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., field, value, n): counts of every field's values in one scan."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def ranges(df: DataFrame, fields: Sequence[str], file: str | None = None) -> DataFrame:
    """(file, field, low, high, n): per file and, under a null file, over all (mergeable minima and maxima)."""
    key = F.col(file) if file else F.lit(None).cast("string")
    long = df.select(key.alias("file"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")).select("file", "x.*")
    return long.rollup("field", "file").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).where("field is not null")


def bounded_counts(df: DataFrame, value: str, order: str, most: int = 64) -> DataFrame:
    """(value, n): counts of the `most` values seen first; all others together under a null value."""
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    first = per.orderBy("_first").limit(most).select(value, F.lit(True).alias("_kept"))
    return per.join(F.broadcast(first), value, "left").groupBy(F.when(F.col("_kept"), F.col(value)).alias(value)).agg(F.sum("n").alias("n"))


def presence(df: DataFrame) -> DataFrame:
    """(field, present) for every column."""
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in df.columns])).alias("x")).select("x.*")


def behaviour_counts(df: DataFrame, keys: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """One row a group with the count of rows that meet each test."""
    return df.groupBy(*keys).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def session_gates(df: DataFrame, session: str, kind: str, least: int) -> DataFrame:
    """One row: sessions, the smallest, and whether all are large enough, have the same kinds and equal counts of each."""
    per = df.groupBy(session, kind).agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy(session).agg(F.sum("n").alias("rows"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.count_distinct("n").alias("sizes"))
    return by.agg(F.count(F.lit(1)).alias("sessions"), F.min("rows").alias("smallest"), F.bool_and(F.col("rows") >= least).alias("large_enough"), (F.count_distinct("kinds") == 1).alias("same_kinds"), F.bool_and(F.col("sizes") == 1).alias("equal_counts"))


def interval_kinds(start: Column, end: Column, duration_s: Column) -> Column:
    """Timing category of a record: exact decimal comparison of end - start with the stated duration."""
    span = (F.unix_micros(end) - F.unix_micros(start)).cast("decimal(20,0)") / 1_000_000
    stated = duration_s.cast("decimal(20,6)")
    return F.when(start.isNull() | end.isNull() | stated.isNull(), "missing").when(span < 0, "reversed").when(span == stated, "exact").when(F.abs(span - stated) < 1, "within_a_second").otherwise("inconsistent")


def day_label_counts(df: DataFrame, t: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date(t).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def parity(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, field, left, right) where two tables differ by more than a tolerance, or one lacks the row or value."""
    a = left.select(key, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a"))
    b = right.select(key, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b"))
    both = a.join(b, key, "full_outer")
    differs = lambda x, y: ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    cells = F.array(*[F.when(differs(F.col("a")[f], F.col("b")[f]), F.struct(F.lit(f).alias("field"), F.col("a")[f].alias("left"), F.col("b")[f].alias("right"))) for f in fields])
    return both.select(key, F.explode(F.array_compact(cells)).alias("x")).select(key, "x.*")


def sequential_filters(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, survivors) of filters applied one after another, in one pass: rows by their first failing step."""
    failing = F.lit(len(steps))
    for at, (_, test) in reversed(list(enumerate(steps))):
        failing = F.when(~F.coalesce(test, F.lit(False)), at).otherwise(failing)
    counts = df.groupBy(failing.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    named = df.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(steps)], "nth int, step string")
    return named.join(counts, F.col("at") > F.col("nth"), "left").groupBy("nth", "step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("survivors")).select("step", "survivors")


def ordered_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of every key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
