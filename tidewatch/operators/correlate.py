"""Alert correlation: provenance verdicts, anchored bursts and campaigns, incidents and their corrections."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.digests import id_set_digest
from tidewatch.session import stored

BURST_SECONDS, CAMPAIGN_SECONDS, MAX_SKEW_SECONDS = 30.0, 600.0, 5.0
#: Keys of more rows are cut into ranges of about so many.
RANGE_ROWS = 250_000


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def rejection_reason(prov: str = "prov", max_skew: float = MAX_SKEW_SECONDS) -> Column:
    """Why a provenance struct is unverified, in a fixed order of checks; null if it is verified.

    A missing struct is a missing namespace. Time texts are ISO; unreadable ones are invalid bounds.
    """
    p = {c: F.col(f"{prov}.{c}") for c in ("entity_namespace_id", "clock_synchronized", "src_entity_id", "dst_entity_id", "address_reuse_or_nat", "max_clock_skew_seconds", "observed_at_utc", "validity_start_utc", "validity_end_utc")}
    skew = p["max_clock_skew_seconds"].cast("double")
    seen, start, end = (F.try_to_timestamp(p[c]) for c in ("observed_at_utc", "validity_start_utc", "validity_end_utc"))
    given = {c: ~F.coalesce(p[c] == "", p[c].isNull()) for c in ("observed_at_utc", "validity_start_utc", "validity_end_utc")}
    watched = given["observed_at_utc"]
    return (
        F.when(_blank(p["entity_namespace_id"]), "missing_entity_namespace")
        .when(~F.coalesce(p["clock_synchronized"], F.lit(False)), "clock_not_synchronized")
        .when(_blank(p["src_entity_id"]), "missing_src_entity_id")
        .when(_blank(p["dst_entity_id"]), "missing_dst_entity_id")
        .when(F.coalesce(p["address_reuse_or_nat"], F.lit(False)), "nat_address_reuse_ambiguous")
        .when(skew.isNull() | F.isnan(skew) | (skew < 0) | (skew > max_skew), "clock_skew_exceeded")
        .when(watched & seen.isNull(), "invalid_timestamp_bounds")
        .when(watched & given["validity_start_utc"] & start.isNull(), "invalid_timestamp_bounds")
        .when(watched & given["validity_start_utc"] & (seen < start), "outside_entity_validity_interval")
        .when(watched & given["validity_end_utc"] & end.isNull(), "invalid_timestamp_bounds")
        .when(watched & given["validity_end_utc"] & (seen > end), "outside_entity_validity_interval")
    )


def _walk(rows: DataFrame, span: int, incoming: str | None = None) -> DataFrame:
    """`rows` with anchor: a task streams once through its rows, sorted by (_key, _us), and holds the open cluster's key and anchor
    only. `incoming`: a column with the anchor that is open before a key's first row; null if none is."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, anchor = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            us, names = batch.column("_us").to_numpy(), batch.column("_key").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            anchors = np.empty(len(us), np.int64)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at, held = low, names[low] == open_key
                if not held and incoming is not None and (before := batch.column(incoming)[low].as_py()) is not None:
                    held, anchor = True, before
                if held:
                    at = low + int(np.searchsorted(us[low:high], anchor + span, "right"))
                    anchors[low:at] = anchor
                while at < high:
                    anchor = int(us[at])
                    end = at + int(np.searchsorted(us[at:high], anchor + span, "right"))
                    anchors[at:end] = anchor
                    at = end
                open_key = names[low]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors)], [*batch.schema.names, "anchor"])

    return rows.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("anchor", T.LongType())]))


def _passage(times: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """How a chain of clusters passes sorted distinct times: (ends, exits), so that one that comes in with anchor a, which covers a + span,
    leaves with the exit of the first end after a + span; with a itself, if there is no such end.

    Jump pointers say which time opens the next cluster; followed to the last cluster from the back, each once. Only
    times within a span of the first can be the first uncovered one, and neighbours with one exit are one entry."""
    n = len(times)
    jump = np.searchsorted(times, times + span, "right").tolist()
    leaves = list(range(n))
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            leaves[i] = leaves[jump[i]]
    entries = times[: min(n, jump[0] + 1)]
    exits = times[np.array(leaves[: len(entries)])]
    last = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(entries) - 1)
    return entries[last].tolist(), exits[last].tolist()


def _in_ranges(rows: DataFrame, keys: Sequence[str], span: int, row_id: str, parts: int) -> DataFrame:
    """The rows of hot keys with their anchors: each key is cut into ranges of time that are walked side by side.

    What a range does to the chain is a small step function of the anchor that comes in (`_passage`). One light task a key composes
    its ranges' functions in order, which gives the anchor that comes into each range: one row a range at most, which is broadcast."""
    placed = stored(rows.repartitionByRange(parts, *keys, "_us", row_id).withColumn("_part", F.spark_partition_id()), "anchored-ranges")
    names = T.StructType([rows.schema[k] for k in keys]).simpleString()[len("struct<") : -1].replace(":", " ")

    def passage(key: tuple, group: pa.Table) -> pa.Table:
        times = np.unique(group.column("_us").to_numpy())
        ends, exits = _passage(times, span)
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, "_part"], key, strict=True)}, "ends": [ends], "exits": [exits]})

    def composed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("_part")
        anchor, come = None, []
        for ends, exits in zip(group.column("ends"), group.column("exits"), strict=True):
            come.append(anchor)
            ends, exits = ends.values.to_numpy(), exits.values.to_numpy()
            at = 0 if anchor is None else int(np.searchsorted(ends, anchor + span, "right"))
            anchor = anchor if at == len(ends) else int(exits[at])
        return group.select([*keys, "_part"]).append_column("_in", pa.array(come, pa.int64()))

    functions = placed.select(*keys, "_part", "_us").groupBy(*keys, "_part").applyInArrow(passage, f"{names}, _part int, ends array<long>, exits array<long>")
    incoming = functions.groupBy(*keys).applyInArrow(composed, f"{names}, _part int, _in long").where("_in is not null")
    walked = placed.join(F.broadcast(incoming), [*keys, "_part"], "left").withColumn("_key", F.xxhash64(*keys, "_part"))
    walked = walked.repartitionById(parts, "_part").sortWithinPartitions(*keys, "_part", "_us", row_id)
    return _walk(walked, span, "_in").drop("_part", "_in")


def anchored_clusters(df: DataFrame, keys: Sequence[str], seconds: float, t: str = "t", row_id: str = "alert_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with anchor (the cluster's first time, in microseconds): a row joins the open cluster of its
    key while it is at most `seconds` after the cluster's first row, and else opens the next one.

    Rows are dealt by key and sorted by (key, time, id) within a task, which then streams through them once. Keys of more than
    `range_rows` rows are cut into ranges of time of about so many rows, each a task (see `_in_ranges`).
    Null times and null keys form no clusters and are dropped; equal times join alike.
    """
    span = int(seconds * 1_000_000)
    rows = df.where(F.col(t).isNotNull()).withColumn("_us", F.unix_micros(F.col(t).cast("timestamp")))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    # Neighbours of different keys are told apart by the keys' hash.
    rows = rows.withColumn("_key", F.xxhash64(*keys))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > range_rows)
    most = hot.agg(F.sum("_rows").alias("rows")).first()["rows"]
    cold = rows
    if most:
        hot = stored(hot.select(*keys), "anchored-hot")
        cold = rows.join(hot, list(keys), "left_anti")
    walked = _walk(cold.repartition(*keys).sortWithinPartitions(*keys, "_us", row_id), span)
    if most:
        walked = walked.unionByName(_in_ranges(rows.join(hot, list(keys), "left_semi"), keys, span, row_id, math.ceil(most / range_rows)))
    return walked.select(*df.columns, "anchor")


def correlate(alerts: DataFrame, burst_seconds: float = BURST_SECONDS, campaign_seconds: float = CAMPAIGN_SECONDS, domain: str = "tidewatch:incident") -> DataFrame:
    """Members (alert_id, incident_id, rule, status, anchor_id, anchor_us, delta_us, .. the alert's columns).

    `alerts` has alert_id, t, ns, src, dst, proto, service, score, decision and optionally reject
    (a reason for unverified provenance). Unverified alerts are incidents of their own. Verified
    ones form bursts within (ns, src, dst, proto, service); those left alone form campaigns within
    (ns, unordered src and dst); the rest are verified singletons. Exact repeats count once.
    """
    rows = alerts.dropDuplicates(["alert_id"])
    if "reject" not in rows.columns:
        rows = rows.withColumn("reject", F.lit(None).cast("string"))
    unverified = F.coalesce(F.col("reject"), F.when(F.col("t").isNull() | F.col("ns").isNull() | F.col("src").isNull() | F.col("dst").isNull(), "missing_entity_namespace"))
    rows = stored(rows.withColumn("reject", unverified).withColumns({"proto": F.coalesce("proto", F.lit("")), "service": F.coalesce("service", F.lit(""))}), "correlate-rows")
    good = rows.where("reject is null")

    def sized(df: DataFrame, keys: list[str], seconds: float) -> DataFrame:
        by = Window.partitionBy(*keys, "anchor")
        first = by.orderBy("t", "alert_id")
        return anchored_clusters(df, keys, seconds).withColumns({"size": F.count(F.lit(1)).over(by), "anchor_id": F.first("alert_id").over(first)})

    burst = stored(sized(good, ["ns", "src", "dst", "proto", "service"], burst_seconds), "correlate-bursts")
    left = burst.where("size = 1").drop("size", "anchor", "anchor_id")
    pair = F.array_sort(F.array("src", "dst"))
    campaign = sized(left.withColumns({"_a": pair[0], "_b": pair[1]}), ["ns", "_a", "_b"], campaign_seconds).drop("_a", "_b")
    named = (
        burst.where("size > 1").withColumns({"rule": F.lit("burst"), "status": F.lit("verified")})
        .unionByName(campaign.withColumns({"rule": F.when(F.col("size") > 1, "campaign").otherwise("singleton"), "status": F.lit("verified")}))
        .unionByName(
            rows.where("reject is not null").withColumns(
                {"anchor": F.unix_micros("t"), "size": F.lit(1).cast("long"), "anchor_id": F.col("alert_id"), "rule": F.lit("unverified"), "status": F.col("reject")}
            )
        )
    )
    ids = named.groupBy("rule", "anchor_id").agg(F.collect_list("alert_id").alias("ids"))
    ids = ids.select("rule", "anchor_id", id_set_digest(domain, [F.lit("incident_v1"), F.col("rule")], F.col("ids")).alias("incident_id"))
    return named.join(ids, ["rule", "anchor_id"]).withColumn("delta_us", F.unix_micros("t") - F.col("anchor")).withColumnRenamed("anchor", "anchor_us")


def incidents(members: DataFrame) -> DataFrame:
    """One row an incident: rule, status, size, highest score, decision (Attack if any member is one,
    else the anchor's), earliest and latest time."""
    return members.groupBy("incident_id", "rule", "status").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("score").alias("max_score"),
        F.when(F.bool_or(F.col("decision") == "Attack"), "Attack").otherwise(F.max(F.when(F.col("alert_id") == F.col("anchor_id"), F.col("decision")))).alias("decision"),
        F.min("t").alias("earliest"),
        F.max("t").alias("latest"),
    )


def reduction(members: DataFrame, alerts: DataFrame, verdict: Column | None = None) -> DataFrame:
    """One row: alerts, incidents, reduction share, and the violations that must be 0: alerts that are
    in no incident or in several, and Attack alerts in incidents that are not. `verdict` is an incident's decision
    where it isn't null, for members that were regrouped or overruled; else `incidents` gives it."""
    per = members.groupBy("alert_id").agg(F.count_distinct("incident_id").alias("n"))
    whole = alerts.select("alert_id").distinct().join(per, "alert_id", "full_outer")
    lost = whole.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("misplaced"))
    decided = incidents(members).select("incident_id", (F.coalesce(verdict, F.col("decision")) if verdict is not None else F.col("decision")).alias("verdict"))
    # One row an incident, also where its members disagree on its rule.
    decided = decided.groupBy("incident_id").agg(F.when(F.bool_or(F.col("verdict") == "Attack"), "Attack").otherwise(F.max("verdict")).alias("verdict"))
    down = members.where("decision = 'Attack'").join(decided, "incident_id")
    down = down.agg(F.count_if(F.col("verdict") != "Attack").alias("downgraded"))
    made = members.agg(F.count_distinct("incident_id").alias("incidents"))
    return lost.crossJoin(made).crossJoin(down).select("alerts", "incidents", F.when(F.col("alerts") > 0, 1 - F.col("incidents") / F.col("alerts")).alias("reduction"), "misplaced", "downgraded")


def apply_corrections(members: DataFrame, corrections: DataFrame, domain: str = "tidewatch:correction") -> DataFrame:
    """Members after manual regrouping: each (request_id, incident_id, alert_id) splits the alert out into
    an incident of its own. A request id counts once, as does a repeated split of one alert."""
    once = corrections.groupBy("request_id").agg(F.min(F.struct("incident_id", "alert_id")).alias("x")).select("request_id", "x.*")
    once = once.groupBy("incident_id", "alert_id").agg(F.min("request_id").alias("request_id"))
    split = members.join(once, ["incident_id", "alert_id"], "left")
    new = id_set_digest(domain, [F.col("request_id").cast("string"), F.col("incident_id")], F.array("alert_id"))
    return split.withColumns({"rule": F.when(F.col("request_id").isNotNull(), "corrected").otherwise(F.col("rule")), "incident_id": F.when(F.col("request_id").isNotNull(), new).otherwise(F.col("incident_id"))}).drop("request_id")


def verified_members(attacks: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Attack rows of at least a score: what correlation runs over."""
    return attacks.where((F.col("decision") == "Attack") & (F.col("score") >= minimum))
