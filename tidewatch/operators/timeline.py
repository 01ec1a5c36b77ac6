"""Ordered views: merged timelines, actor runs, rolling counts, pages, as-of look-ups, claims, triage order."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import ranks
from tidewatch.session import stored

#: Keys of more rows are counted in parts.
RANGE_ROWS = 250_000


def merged(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """Union of event tables with a `kind`, ordered by (at, kind, ref); a missing `at` sorts first."""
    tables = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return union.orderBy("at", "kind", "ref")


def actor_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], actor: str) -> DataFrame:
    """`df` with `run`, which counts up whenever the actor changes within a key (nulls are equal).

    A key is cut into parts by the order; a part takes over the last actor and the number of runs of those before it."""
    seen = F.struct(F.col(actor).alias("actor"))
    placed = ranks.carried(ranks.in_parts(df, keys, order), keys, F.max_by(seen, F.struct(*order)), "_held", lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*keys, ranks.PART).orderBy(*order)
    placed = placed.withColumn("_before", F.coalesce(F.lag(seen).over(inside), F.col("_held")))
    new = F.when(F.col("_before").isNull(), 1).when(~F.col(actor).eqNullSafe(F.col("_before.actor")), 1).otherwise(0).cast("long")
    placed = ranks.carried(stored(placed.withColumn("_new", new).drop("_held", "_before"), "runs"), keys, F.sum("_new"), "_runs")
    run = F.coalesce("_runs", F.lit(0)) + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("run", run).select(*df.columns, "run")


def recent_counts(df: DataFrame, keys: Sequence[str], t: str, seconds: float, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with `recent` (rows of the key in the half-open window of `seconds` that ends here), `limited`
    (recent >= limit) and `wait_seconds` until the oldest of them leaves.

    A key is a window in one task. Keys of more than `range_rows` rows are counted by running sums over their distinct times instead,
    in parts (see `ranks`)."""
    span = int(seconds * 1_000_000)
    rows = df.withColumn("_us", F.unix_micros(t))
    known = F.col("_us").isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    hot = rows.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > range_rows).select(*keys)
    cold, found = rows, []
    if keys and hot.limit(1).count():
        hot = stored(hot, "recent-hot")
        warm = rows.where(known).join(hot, list(keys), "left_semi")
        found = [warm.join(_window_counts(warm, keys, span), [*keys, "_us"])]
        cold = rows.where(known).join(hot, list(keys), "left_anti").unionByName(rows.where(~known))
    window = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = cold.withColumns({"recent": F.count(F.lit(1)).over(window), "_first": F.min("_us").over(window)})
    for part in found:
        counted = counted.unionByName(part)
    limited = F.col("recent") >= limit
    return counted.withColumns({"limited": limited, "wait_seconds": F.when(limited, (F.col("_first") + span - F.col("_us")) / 1e6).otherwise(0.0)}).select(*df.columns, "recent", "limited", "wait_seconds")


def _window_counts(rows: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """(keys.., _us, recent, _first) for each distinct time: the rows up to it less those up to `span` before it. The oldest row in the
    window is at the time before which just as many rows lie as have left it."""
    per = rows.groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_c"))
    here = per.select(*keys, "_us", F.col("_us").alias("_at"), F.lit(0).alias("_gone"), "_c")
    past = per.select(*keys, "_us", (F.col("_us") - span).alias("_at"), F.lit(1).alias("_gone"), F.lit(0).cast("long").alias("_c"))
    run = ranks.with_running(here.unionByName(past), keys, [F.col("_at"), F.col("_gone")], "_upto", "_c")
    of = lambda gone, c: F.max(F.when(F.col("_gone") == gone, c))
    both = stored(run.groupBy(*keys, "_us").agg(of(0, F.col("_upto")).alias("_now"), of(0, F.col("_upto") - F.col("_c")).alias("_before"), of(1, F.col("_upto")).alias("_left")), "recent-counts")
    oldest = both.select(*keys, F.col("_before").alias("_left"), F.col("_us").alias("_first"))
    return both.join(oldest, [*keys, "_left"]).select(*keys, "_us", (F.col("_now") - F.col("_left")).alias("recent"), "_first")


def page(df: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def latest_before(rows: DataFrame, facts: DataFrame, keys: Sequence[str], t: str, row_id: str, value: str) -> DataFrame:
    """As-of join: every row with the value of its key's latest fact at or before it; one union, ordered by key and time in parts,
    each of which takes over the latest fact of those before it.

    Facts at a row's own time count; of several at one time, the largest id. No fact: null."""
    both = rows.withColumn("_fact", F.lit(1)).unionByName(facts.where(F.col(value).isNotNull()).select(*keys, t, row_id, value).withColumn("_fact", F.lit(0)), allowMissingColumns=True)
    order = [F.col(t), F.col("_fact"), F.col(row_id)]
    latest = F.max_by(value, F.when(F.col("_fact") == 0, F.struct(t, row_id)))
    placed = ranks.carried(ranks.in_parts(both, keys, order), keys, latest, "_held", lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*keys, ranks.PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_held"))
    return found.where("_fact = 1").drop("_fact", "_held", ranks.PART)


def first_claims(df: DataFrame, key: str, order: Sequence[str], evidence: str) -> DataFrame:
    """(key, evidence, claims, conflict): the first claim of a key wins; a later one with other evidence is a conflict."""
    return df.groupBy(key).agg(F.min_by(evidence, F.struct(*order)).alias(evidence), F.count(F.lit(1)).alias("claims"), (F.count_distinct(evidence) > 1).alias("conflict"))


def insert_outcomes(held: DataFrame, new: DataFrame, key: str, evidence: Sequence[str]) -> DataFrame:
    """(key, outcome) for new rows against held ones: inserted, same or conflict."""
    known = held.select(key, F.struct(*evidence).alias("_old"))
    old, now = F.col("_old"), F.struct(*evidence)
    outcome = F.when(old.isNull(), "inserted").when(old.eqNullSafe(now), "same").otherwise("conflict")
    return new.join(known, key, "left").select(key, outcome.alias("outcome"))


def triage_queue(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Rows of at least a score with their `position` in the order burst size, anomaly ratio, score (all
    descending), id. Positions come from range-partitioned sorted parts, not from one global window."""
    order = [F.desc(F.coalesce("burst_count", F.lit(1))), F.desc(F.coalesce("ratio", F.lit(0.0))), F.desc("score"), F.col("alert_id").asc()]
    return ranks.with_rank(df.where(F.col("score") >= minimum), [], order, "position")
