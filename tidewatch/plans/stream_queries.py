"""Streams over files written from a table, run until they have read what is there, against SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import burst, correlate
from tidewatch.plans import correlation_queries as c
from tidewatch.plans.registry import query
from tidewatch.plans.views import ALERTS_SQL, alerts, table
from tidewatch.session import shared_dir
from tidewatch.sources.adapters import follow_lines
from tidewatch.streaming import jobs

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _source(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet and read again as a stream, and a folder for what the stream leaves."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder


def _landed(stream: DataFrame, folder: str) -> DataFrame:
    """The rows that an appending stream leaves once it has read all files."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("st1_ingest", "SELECT CASE WHEN event_id % 7 = 0 THEN 'dead_letter' WHEN event_type = 'view' THEN 'flow' ELSE 'skipped' END AS route, count(*) AS n, count_if(event_id % 7 <> 0 AND event_type = 'view') AS flows, count_if(event_id % 7 = 0) AS letters FROM events GROUP BY 1")
def st1_ingest(spark, sf_dir):
    """Counts by route, and what is stored of flows and dead letters."""
    lines = table(spark, sf_dir, "events").selectExpr(
        "if(event_id % 7 = 0, '{\"broken', to_json(named_struct('timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'flow_id', event_id, 'event_type', if(event_type = 'view', 'flow', event_type), 'src_ip', concat('10.0.0.', user_id % 250), 'dest_ip', '10.1.1.1', 'src_port', 1000, 'dest_port', 443, 'proto', 'TCP', 'flow', named_struct('pkts_toserver', 3, 'pkts_toclient', 2, 'bytes_toserver', 100, 'bytes_toclient', 50, 'age', 1)))) as value"
    )
    stream, folder = _source(lines, "st1")
    jobs.ingest_sensor_lines(stream, f"{folder}/flows", f"{folder}/dead", f"{folder}/state").awaitTermination()
    counts = spark.read.parquet(f"{folder}/dead-counts").groupBy("route").agg(F.sum("n").alias("n"))
    flows, dead = spark.read.parquet(f"{folder}/flows"), spark.read.parquet(f"{folder}/dead")
    held = flows.agg(F.count("event_id").alias("flows")).withColumn("route", F.lit("flow")).unionByName(dead.agg(F.count("excerpt").alias("letters")).withColumn("route", F.lit("dead_letter")), allowMissingColumns=True)
    return counts.join(held, "route", "left").fillna(0, ["flows", "letters"])


@query("st2_first_events", "SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def st2_first_events(spark, sf_dir):
    """Every event is sent twice and counts once."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    stream, folder = _source(events.union(events), "st2")
    return _landed(jobs.without_repeats(stream, "event_id", "ts", "400 days"), folder).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("st3_bursts", f"{c._BURSTS_SQL} SELECT alert_id, burst_no, row_number() OVER (PARTITION BY src, dst, proto, burst_no ORDER BY t, alert_id) AS burst_count FROM b")
def st3_bursts(spark, sf_dir):
    rows = c.simhashed(spark, sf_dir).select(F.concat_ws("|", "src", "dst", "proto").alias("key"), "alert_id", F.unix_micros("t").alias("us"), "simhash")
    stream, folder = _source(rows, "st3")
    return _landed(jobs.burst_stream(stream, idle=c.BURST, distance=burst.MAX_DISTANCE), folder).select("alert_id", "burst_no", "burst_count")


@query(
    "st4_closed_clusters",
    f"""{c._BURST_SQL.replace("WHERE decision = 'Attack' AND score >= 0.5", "")}
SELECT concat_ws('|', ns, src, dst, proto, service) AS key, epoch_us(anchor) AS anchor_us, count(*) AS size FROM bs GROUP BY ALL HAVING epoch_us(anchor) + 21600000000 < (SELECT epoch_us(max(t)) // 1000 * 1000 - 1000000 FROM alerts)""",
)
def st4_closed_clusters(spark, sf_dir):
    """Anchored clusters that the watermark (a second behind the last row) has passed."""
    rows = alerts(spark, sf_dir).select(F.concat_ws("|", "ns", "src", "dst", "proto", "service").alias("key"), "alert_id", F.unix_micros("t").alias("us"), "t")
    stream, folder = _source(rows, "st4")
    return _landed(jobs.anchored_stream(stream, c.BURST, delay="1 second"), folder).select("key", "anchor_us", "size")


@query(
    "st5_latest_signature",
    """WITH a AS (SELECT user_id, ts, event_id, event_type AS signature FROM events WHERE event_type = 'error' OR event_type = 'purchase'), f AS (SELECT * FROM events WHERE event_type IN ('click', 'view'))
SELECT f.event_id AS alert_id, (SELECT arg_max(a.signature, (a.ts, a.event_id)) FROM a WHERE a.user_id = f.user_id AND a.ts <= f.ts) AS signature FROM f""",
)
def st5_latest_signature(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error', 'purchase')").selectExpr("cast(user_id as string) as key", "event_id as alert_id", "unix_micros(ts) as us", "if(event_type in ('error', 'purchase'), event_type, null) as signature")
    stream, folder = _source(rows, "st5")
    return _landed(jobs.signature_stream(stream), folder).select("alert_id", "signature")


@query(
    "st6_failure_windows",
    """WITH f AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, epoch_us(day) AS start_us, failures, failures >= 2 AS limited FROM f WHERE epoch_us(day) + 86400000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 FROM events WHERE event_type = 'error')""",
)
def st6_failure_windows(spark, sf_dir):
    """Failures per user and day, for the days that the watermark has passed."""
    stream, folder = _source(table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts"), "st6")
    counted = jobs.rolling_failures(stream, "user_id", "ts", "1 day", "1 day", limit=2)
    return _landed(counted.select("user_id", F.unix_micros("window.start").alias("start_us"), "failures", "limited"), folder)


@query("st7_running_funnel", f"WITH alerts AS ({ALERTS_SQL}) SELECT count(*) AS flows, count_if(decision = 'Attack') AS attacks, count_if(decision = 'Attack' AND score >= 0.9) AS sure FROM alerts")
def st7_running_funnel(spark, sf_dir):
    """The funnel's last state; each batch writes it anew."""
    stream, folder = _source(alerts(spark, sf_dir).select("decision", "score"), "st7")
    funnel = jobs.running_funnel(stream, "decision", "score")
    funnel.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("st8_late_rows", "SELECT count(*) AS late, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def st8_late_rows(spark, sf_dir):
    """Rows behind a watermark land in their own sink."""
    stream, folder = _source(table(spark, sf_dir, "events").select("event_id", "ts"), "st8")
    jobs.late_rows(stream, "ts", lambda: 1_704_844_800_000_000, f"{folder}/late", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_id long, ts timestamp").parquet(f"{folder}/late").agg(F.count(F.lit(1)).alias("late"), F.sum("event_id").alias("ids"))


@query(
    "s8_followed_lines",
    """WITH a AS (SELECT user_id % 50 AS u, date_trunc('second', ts) AS t, max(event_id) AS id FROM events WHERE event_type = 'error' GROUP BY ALL),
f AS (SELECT event_id, user_id % 50 AS u, date_trunc('second', ts) AS t FROM events WHERE event_type = 'view' AND user_id % 10 <> 3)
SELECT f.event_id AS alert_id, (SELECT 'sig ' || arg_max(a.id, a.t) FROM a WHERE a.u = f.u AND a.t <= f.t) AS signature FROM f""",
)
def s8_followed_lines(spark, sf_dir):
    """A sensor's mixed lines: flows get the latest signature of their pair, protocol and port; noise and other lines are left out."""
    lines = table(spark, sf_dir, "events").selectExpr(
        """to_json(named_struct('timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'flow_id', event_id, 'event_type', case event_type when 'error' then 'alert' when 'view' then 'flow' else 'dns' end,
 'src_ip', concat('10.0.0.', user_id % 50), 'dest_ip', '10.1.1.1', 'dest_port', if(event_type = 'view' and user_id % 10 = 3, 5353, 443), 'proto', if(event_type = 'view', 'TCP', 'tcp'),
 'alert', if(event_type = 'error', named_struct('signature', concat(' sig ', event_id)), null))) as value"""
    )
    stream, folder = _source(lines, "s8")
    return _landed(jobs.signature_stream(follow_lines(stream)), folder).select("alert_id", "signature")


_WATERMARK = "(SELECT epoch_us(max(t)) // 1000 * 1000 - 1000000 FROM alerts)"


def _keyed(spark, sf_dir):
    return alerts(spark, sf_dir).select(F.concat_ws("|", "ns", "src", "dst", "proto", "service").alias("key"), "alert_id", F.unix_micros("t").alias("us"), "t")


@query(
    "st3_settled_bursts",
    f"""{c._BURSTS_SQL} SELECT alert_id, epoch_us(min(t) OVER (PARTITION BY src, dst, proto, burst_no)) AS burst_us, row_number() OVER (PARTITION BY src, dst, proto, burst_no ORDER BY t, alert_id) AS burst_count
FROM b QUALIFY epoch_us(t) <= {_WATERMARK}""",
)
def st3_settled_bursts(spark, sf_dir):
    """Bursts of the rows that the watermark has passed, in order of time; idle keys end."""
    rows = c.simhashed(spark, sf_dir).select(F.concat_ws("|", "src", "dst", "proto").alias("key"), "alert_id", F.unix_micros("t").alias("us"), "simhash", "t")
    stream, folder = _source(rows, "st3-settled")
    return _landed(jobs.settled_bursts(stream, c.BURST, burst.MAX_DISTANCE, delay="1 second"), folder).select("alert_id", "burst_us", "burst_count")


_CLOSED = f"epoch_us(anchor) + 21600000000 < {_WATERMARK}"
_INCIDENTS_SQL = (
    c._CAMPAIGN_SQL.replace("WHERE decision = 'Attack' AND score >= 0.5", "")
    .replace("FROM bs WHERE size = 1)", f"FROM bs WHERE size = 1 AND {_CLOSED})")
    .replace("FROM bs WHERE size > 1", f"FROM bs WHERE size > 1 AND {_CLOSED}")
    .replace("'singleton' END FROM cs)", "'singleton' END FROM cs WHERE epoch_us(anchor) + 172800000000 < (SELECT epoch_us(max(t)) // 1000 * 1000 - 1000000 FROM cl))")
)


@query("st4_campaigns", f"{_INCIDENTS_SQL} SELECT m.alert_id, i.incident_id, m.rule, epoch_us(m.anchor) AS anchor_us, m.size FROM mem m JOIN ids i ON m.rule = i.rule AND m.anchor_id = i.anchor_id")
def st4_campaigns(spark, sf_dir):
    """Both passes over all alerts: members of what they have closed, under the ids of the batch correlation."""
    stream, folder = _source(alerts(spark, sf_dir), "st4-incidents")
    jobs.start_incidents(stream, folder, c.BURST, c.CAMPAIGN, delay="1 second")
    bursts, campaigns = (spark.read.schema(jobs.CLUSTER_OUT).parquet(f"{folder}/{name}") for name in ("bursts", "campaigns"))
    return jobs.closed_members(bursts, campaigns)


@query(
    "st5_kept_signatures",
    """WITH a AS (SELECT user_id, ts, event_id, event_type AS signature FROM events WHERE event_type = 'error' OR event_type = 'purchase'), f AS (SELECT * FROM events WHERE event_type IN ('click', 'view'))
SELECT f.event_id AS alert_id, (SELECT arg_max(a.signature, (a.ts, a.event_id)) FROM a WHERE a.user_id = f.user_id AND a.ts <= f.ts AND epoch_us(f.ts) - epoch_us(a.ts) <= 172800000000) AS signature
FROM f WHERE epoch_us(f.ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 1000000 FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase'))""",
)
def st5_kept_signatures(spark, sf_dir):
    """As-of signatures that are forgotten after two days."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error', 'purchase')").selectExpr("cast(user_id as string) as key", "event_id as alert_id", "unix_micros(ts) as us", "if(event_type in ('error', 'purchase'), event_type, null) as signature", "ts as t")
    stream, folder = _source(rows, "st5-kept")
    return _landed(jobs.settled_signatures(stream, 2 * 86400.0, delay="1 second"), folder).select("alert_id", "signature")


@query(
    "st6_exact_counts",
    """WITH f AS (SELECT * FROM events WHERE event_type = 'error'), w AS (SELECT event_id, ts, count(*) OVER r AS recent, min(epoch_us(ts)) OVER r AS first_us FROM f
 WINDOW r AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))
SELECT event_id AS alert_id, recent, recent >= 2 AS limited, CASE WHEN recent >= 2 THEN (first_us + 86400000000 - epoch_us(ts)) / 1e6 ELSE 0.0 END AS wait_seconds
FROM w WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 1000000 FROM f)""",
)
def st6_exact_counts(spark, sf_dir):
    """Failures of a user within a day, exact and row by row."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("cast(user_id as string) as key", "event_id as alert_id", "unix_micros(ts) as us", "ts as t")
    stream, folder = _source(rows, "st6-exact")
    return _landed(jobs.settled_counts(stream, 86400.0, limit=2, delay="1 second"), folder).select("alert_id", "recent", "limited", "wait_seconds")


@query(
    "st8_reconciled",
    f"""{c._BURST_SQL.replace("WHERE decision = 'Attack' AND score >= 0.5", "")}
SELECT concat_ws('|', ns, src, dst, proto, service) AS key, epoch_us(anchor) AS anchor_us, count(*) AS size FROM bs GROUP BY ALL HAVING epoch_us(anchor) + 21600000000 < {_WATERMARK}""",
)
def st8_reconciled(spark, sf_dir):
    """Every 37th alert arrives after all others. Most are late: the stream's clusters lack them until they are reconciled."""
    rows = _keyed(spark, sf_dir)
    stream, folder = _source(rows.where("alert_id % 37 <> 0"), "st8-reconciled")
    rows.where("alert_id % 37 = 0").write.mode("append").parquet(f"{folder}/in")
    # The late rows' files are newer; a batch takes one file, in order of their times.
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.land_split(stream, "t", 1.0, folder, f"{folder}/split-state").awaitTermination()
    on_time, late = (spark.read.schema(rows.schema).parquet(f"{folder}/{name}") for name in ("on_time", "late"))
    landed = spark.readStream.schema(on_time.schema).parquet(f"{folder}/on_time")
    streamed = _landed(jobs.anchored_stream(landed, c.BURST, delay="1 second"), folder).select("key", "anchor_us", "size")
    newest = on_time.agg((F.floor(F.max("us") / 1000) * 1000 - 1_000_000).alias("mark"))  # one row

    def batch(df: DataFrame) -> DataFrame:
        made = correlate.anchored_clusters(df, ["key"], c.BURST).groupBy("key", F.col("anchor").alias("anchor_us")).agg(F.count(F.lit(1)).alias("size"))
        return made.crossJoin(F.broadcast(newest)).where(F.col("anchor_us") + int(c.BURST * 1_000_000) < F.col("mark"))

    return jobs.reconciled(streamed, on_time, late, ["key"], batch)
