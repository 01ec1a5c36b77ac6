"""Burst de-duplication by SimHash and idle time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.digests import hamming, normal_token, simhash64
from tidewatch.operators import ranks
from tidewatch.session import stored

IDLE_SECONDS, MAX_DISTANCE = 60.0, 3


def flow_simhash(src: Column, dst: Column, port: Column, proto: Column, technique: Column, signature: Column) -> Column:
    """64-bit SimHash of a flow's six identity fields."""
    filled = [normal_token(src), normal_token(dst)]
    filled += [F.when(normal_token(port) == "", "0").otherwise(normal_token(port)), F.when(normal_token(proto) == "", "tcp").otherwise(normal_token(proto))]
    return simhash64([*filled, normal_token(technique), normal_token(signature)])


def bursts(df: DataFrame, key: list[str], t: str = "t", simhash: str = "simhash", row_id: str = "alert_id", idle: float = IDLE_SECONDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """`df` with burst_no (per key), burst_count (rows so far) and burst_total: a row continues a burst while
    it comes at most `idle` seconds after the key's last row and differs in at most `distance` bits from it.

    A key is cut into parts by time; a part takes over the last row, the bursts and the rows of those before it."""
    order = [F.col(t), F.col(row_id)]
    seen = F.struct(F.col(t).alias("t"), F.col(simhash).alias("h"))
    placed = ranks.carried(ranks.in_parts(df, key, order), key, F.max_by(seen, F.struct(t, row_id)), "_held", lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*key, ranks.PART).orderBy(*order)
    before = F.coalesce(F.lag(seen).over(inside), F.col("_held"))
    placed = placed.withColumn("_before", before).drop("_held")
    gap, far = F.unix_micros(t) - F.unix_micros("_before.t"), hamming(F.col(simhash), F.col("_before.h"))
    new = F.when(F.col("_before.t").isNull(), 1).when((gap > int(idle * 1_000_000)) | (far > distance), 1).otherwise(0).cast("long")
    rows = stored(placed.withColumn("_new", new).drop("_before"), "bursts")
    rows = ranks.carried(ranks.carried(rows, key, F.sum("_new"), "_bursts"), key, F.count(F.lit(1)), "_rows")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"burst_no": F.coalesce("_bursts", F.lit(0)) + F.sum("_new").over(upto), "_nth": F.coalesce("_rows", F.lit(0)) + F.row_number().over(inside)})
    rows = rows.drop("_new", "_bursts", "_rows", ranks.PART)
    per = rows.groupBy(*key, "burst_no").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("burst_total"))
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in (*key, "burst_no")], "_first", "burst_total")
    same = F.lit(True)
    for c in (*key, "burst_no"):
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = rows.join(per, same).withColumn("burst_count", (F.col("_nth") - F.col("_first") + 1).cast("int"))
    return rows.drop("_nth", "_first", *[f"_by_{c}" for c in (*key, "burst_no")]).select(*df.columns, "burst_no", "burst_count", "burst_total")


def fatigue_funnel(df: DataFrame, key: list[str], t: str = "t", row_id: str = "alert_id", simhash: str = "simhash", score: str = "score", idle: float = IDLE_SECONDS, sure: float = 0.9, weight: str | None = None) -> DataFrame:
    """One row: raw weight (per idle-gap bucket of a key, the larger of its rows and its highest recorded
    weight), SimHash clusters, clusters with a score of `sure` or more, and the reduction in percent.

    A key is cut into parts by time; a part takes over the last time and the number of buckets of those before it."""
    order = [F.col(t), F.col(row_id)]
    seen = F.struct(F.col(t).alias("t"))
    placed = ranks.carried(ranks.in_parts(df, key, order), key, F.max_by(seen, F.struct(t, row_id)), "_held", lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*key, ranks.PART).orderBy(*order)
    before = F.coalesce(F.lag(seen).over(inside), F.col("_held"))
    placed = placed.withColumn("_before", before)
    gap = F.unix_micros(F.col(t)) - F.unix_micros("_before.t")
    cut = F.when(F.col(t).isNull() | F.col("_before.t").isNull() | (gap > int(idle * 1_000_000)), 1).otherwise(0).cast("long")
    placed = stored(placed.withColumn("_cut", cut).drop("_held", "_before"), "fatigue")
    placed = ranks.carried(placed, key, F.sum("_cut"), "_cuts")
    bucketed = placed.withColumn("_bucket", F.coalesce("_cuts", F.lit(0)) + F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per = bucketed.groupBy(*key, "_bucket").agg(F.greatest(F.count(F.lit(1)), F.max(F.col(weight)) if weight else F.lit(0)).alias("w"))
    clusters = df.agg(F.count_distinct(simhash).alias("clusters"), F.count_distinct(F.when(F.col(score) >= sure, F.col(simhash))).alias("sure_clusters"))
    raw = per.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("raw_weight"))
    return raw.crossJoin(clusters).withColumn("reduction_pct", F.when(F.col("raw_weight") > 0, 100.0 * (F.col("raw_weight") - F.col("clusters")) / F.col("raw_weight")))


def near_simhashes(df: DataFrame, simhash: str = "simhash", distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct SimHashes within `distance` (at most 3) bits: four 16-bit bands, one of which must agree."""
    if not 0 <= distance <= 3:
        raise ValueError("four bands find distances of at most 3")
    seen = df.select(F.col(simhash).alias("h")).where("h is not null").distinct()
    bands = seen.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(3))))
    bands = bands.withColumn("value", F.expr("shiftrightunsigned(h, band * 16) & 65535"))
    met = bands.alias("x").join(bands.alias("y"), F.expr("x.band = y.band and x.value = y.value and x.h < y.h"))
    return met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct().withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= distance)
