"""Streams against the batch operators on the same rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import burst, correlate, timeline
from tidewatch.plans.views import alerts
from tidewatch.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """The alert view as a file stream of several batches in time order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = jobs.with_stream_keys(alerts(spark, SF), ["src", "dst"])
    rows.orderBy("t").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_bursts_agree_with_batch(spark, parts, tmp_path):
    rows, stream = parts
    got = {tuple(r) for r in run(jobs.burst_stream(stream.select("key", "alert_id", "us", "simhash"), idle=21600.0), tmp_path, "bursts").select("alert_id", "burst_no", "burst_count").collect()}
    want = {tuple(r) for r in burst.bursts(rows, ["key"], idle=21600.0).select("alert_id", "burst_no", "burst_count").collect()}
    assert got == want


def test_anchored_clusters_agree_with_batch_once_closed(spark, parts, tmp_path):
    rows, stream = parts
    closed = run(jobs.anchored_stream(stream.select("key", "alert_id", "us", "t"), 21600.0, delay="1 second"), tmp_path, "clusters")
    got = {(r.key, r.anchor_us): r["size"] for r in closed.collect()}
    want = {(r.key, r.anchor): r["n"] for r in correlate.anchored_clusters(rows, ["key"], 21600.0).groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)


def test_signatures_agree_with_batch(spark, parts, tmp_path):
    rows, stream = parts
    mark = F.when(F.col("proto") == "icmp", F.col("service"))
    got = {tuple(r) for r in run(jobs.signature_stream(stream.select("key", "alert_id", "us", mark.alias("signature"))), tmp_path, "signs").select("alert_id", "signature").collect()}
    facts = rows.where("proto = 'icmp'").select("key", "us", "alert_id", F.col("service").alias("signature"))
    want = {tuple(r) for r in timeline.latest_before(rows.where("proto <> 'icmp'").select("key", "us", "alert_id"), facts, ["key"], "us", "alert_id", "signature").select("alert_id", "signature").collect()}
    assert got == want


@pytest.fixture
def only_batches_with_rows(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_state_of_the_forms_at_once_ends(spark, only_batches_with_rows, tmp_path):
    """A key that is idle for longer than it is kept leaves no row of state, and starts anew; one in time goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "key string, alert_id long, us long, simhash long, signature string"

    def turns(form, columns, name, batches, keep, wait):
        folder, held = tmp_path / f"{name}-in", []
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream = form(spark.readStream.schema(schema).parquet(str(folder)).select("key", "alert_id", "us", *columns), keep=keep)
            query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(str(tmp_path / f"{name}-out"))
            assert query.awaitTermination(90)
            held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
            time.sleep(wait)
        return spark.read.parquet(str(tmp_path / f"{name}-out")), held

    first, second = [("a", 1, 0, 0, "s"), ("b", 2, 0, 0, "s"), ("a", 3, 90_000_000, 0, None)], [("a", 4, 200_000_000, 0, None)]
    kept, _ = turns(jobs.burst_stream, ["simhash"], "kept", [first, second], 600.0, 0)
    assert {r.alert_id: r.burst_no for r in kept.collect()} == {1: 1, 2: 1, 3: 2, 4: 3}
    ended, held = turns(jobs.burst_stream, ["simhash"], "ended", [first, second], 2.0, 4)
    assert {r.alert_id: r.burst_no for r in ended.collect()} == {1: 1, 2: 1, 3: 2, 4: 1}
    assert held[1] < held[0]
    signs, _ = turns(jobs.signature_stream, ["signature"], "signs-kept", [first, second], 600.0, 0)
    assert {r.alert_id: r.signature for r in signs.collect()} == {3: "s", 4: "s"}
    signs, held = turns(jobs.signature_stream, ["signature"], "signs-ended", [first, second], 2.0, 4)
    assert {r.alert_id: r.signature for r in signs.collect()} == {3: "s", 4: None}
    assert held[1] == 0
    with pytest.raises(ValueError):
        jobs.kept_for(0)


def test_repeats_and_counts(spark, parts, tmp_path):
    _, stream = parts
    assert run(jobs.without_repeats(stream.union(stream).select("alert_id", "t"), "alert_id", "t", "40 days"), tmp_path, "once").count() == alerts(spark, SF).count()
    total = run(jobs.running_funnel(stream, "decision", "score"), tmp_path, "funnel", "complete").first()
    assert total.flows == alerts(spark, SF).count() and total.attacks >= total.sure
    windows = run(jobs.rolling_failures(stream, "src", "t", "1 day", "1 day"), tmp_path, "failures", "update")
    assert windows.count() > 0
    on_time, late = jobs.split_late(alerts(spark, SF), "t", 1_705_276_800_000_000)
    assert on_time.count() + late.count() == total.flows


def test_sensor_lines_land(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:05Z", "flow_id": 7, "event_type": "flow", "src_ip": "10.0.0.5", "dest_ip": "10.0.0.6", "src_port": 5000, "dest_port": 443, "proto": "TCP",
            "flow": {"pkts_toserver": 3, "pkts_toclient": 2, "bytes_toserver": 300, "bytes_toclient": 200, "age": 4, "start": "2024-01-01T00:00:01Z", "end": "2024-01-01T00:00:01Z"}}
    lines = [json.dumps(good), "", "{broken", json.dumps({"event_type": "dns"}), json.dumps(good | {"src_ip": "300.1.1.1"}), json.dumps({"a": 1}), json.dumps(good | {"flow": None})]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(lines))
    stream = spark.readStream.text(str(tmp_path / "lines"))
    jobs.ingest_sensor_lines(stream, str(tmp_path / "flows"), str(tmp_path / "dead"), str(tmp_path / "ck")).awaitTermination(60)
    flow = spark.read.parquet(str(tmp_path / "flows")).collect()
    assert len(flow) == 1 and flow[0].duration_ms == 4000.0 and flow[0].protocol == "tcp"
    codes = sorted(r.code for r in spark.read.parquet(str(tmp_path / "dead")).collect())
    assert codes == ["invalid_flow", "invalid_src_ip", "malformed_json", "missing_event_type"]


BURST_US = 21_600_000_000


def watermark(rows, delay_us=1_000_000):
    newest = rows.agg(F.max("us")).first()[0]
    return newest // 1000 * 1000 - delay_us


def shuffled(spark, rows, tmp_path, name, files=6):
    """Rows as a stream whose files come in order of time but whose rows arrive up to two days early or late."""
    moved = rows.withColumn("_arrives", F.col("us") + F.pmod(F.xxhash64("alert_id"), F.lit(2 * 86400)) * 1_000_000)
    path = str(tmp_path / name)
    ordered = moved.orderBy("_arrives").drop("_arrives").collect()
    step = -(-len(ordered) // files)
    for at in range(0, len(ordered), step):
        spark.createDataFrame(ordered[at : at + step], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def land(df, tmp_path, name):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name)), query


DELAY = "3 days"
DELAY_US = 3 * 86_400_000_000


def test_settled_forms_equal_batch_in_any_order_of_arrival(spark, parts, tmp_path):
    rows, _ = parts
    mark = watermark(rows, DELAY_US)
    stream = shuffled(spark, rows.select("key", "alert_id", "us", "simhash", "t"), tmp_path, "any")
    got, _ = land(jobs.settled_bursts(stream, 21600.0, delay=DELAY), tmp_path, "bursts")
    batch = burst.bursts(rows, ["key"], idle=21600.0)
    first = batch.groupBy("key", "burst_no").agg(F.min("us").alias("burst_us"))
    want = batch.join(first, ["key", "burst_no"]).where(F.col("us") <= mark).select("alert_id", "burst_us", "burst_count")
    assert sorted(map(tuple, got.select("alert_id", "burst_us", "burst_count").collect())) == sorted(map(tuple, want.collect()))

    got, _ = land(jobs.settled_counts(stream.select("key", "alert_id", "us", "t"), 86400.0, limit=3, delay=DELAY), tmp_path, "counts")
    want = timeline.recent_counts(rows, ["key"], "t", 86400.0, 3).where(F.col("us") <= mark).select("alert_id", "recent", "limited", "wait_seconds")
    assert sorted(map(tuple, got.select("alert_id", "recent", "limited", "wait_seconds").collect())) == sorted(map(tuple, want.collect()))


def test_settled_signatures_equal_batch_and_are_forgotten(spark, parts, tmp_path):
    rows, _ = parts
    keep = 5 * 86400
    signed = rows.select(F.lit("k").alias("key"), "alert_id", "us", F.when(F.col("proto") == "icmp", F.col("service")).alias("signature"), "t")
    got, _ = land(jobs.settled_signatures(shuffled(spark, signed, tmp_path, "signs-in"), keep, delay=DELAY), tmp_path, "signs")
    facts = signed.where("signature is not null").select("key", "us", "alert_id", F.struct("us", "signature").alias("sign"))
    held = timeline.latest_before(signed.where("signature is null").select("key", "us", "alert_id"), facts, ["key"], "us", "alert_id", "sign")
    want = held.where(F.col("us") <= watermark(rows, DELAY_US)).select("alert_id", F.when(F.col("us") - F.col("sign.us") <= keep * 1_000_000, F.col("sign.signature")))
    assert sorted(map(tuple, got.select("alert_id", "signature").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("form", ["bursts", "counts", "signatures", "anchored"])
def test_state_of_idle_keys_ends(spark, tmp_path, form):
    """Keys that fall silent hold nothing once the watermark has passed what they can matter for."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [(f"k{i % 20}", i, 1_700_000_000_000_000 + i * 1_000_000, 5, "s" if i % 2 else None) for i in range(100)]
    late = [("other", 1000, 1_700_000_900_000_000, 5, None), ("other", 1001, 1_700_001_800_000_000, 5, None)]
    for n, part in enumerate((rows, late[:1], late[1:])):
        frame = spark.createDataFrame(part, "key string, alert_id long, us long, simhash long, signature string").withColumn("t", F.timestamp_micros("us"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = {
        "bursts": lambda: jobs.settled_bursts(stream.drop("signature"), 60.0, delay="1 second"),
        "counts": lambda: jobs.settled_counts(stream.drop("signature", "simhash"), 60.0, delay="1 second"),
        "signatures": lambda: jobs.settled_signatures(stream.drop("simhash"), 60.0, delay="1 second"),
        "anchored": lambda: jobs.anchored_stream(stream.drop("simhash", "signature"), 60.0, delay="1 second"),
    }[form]()
    _, query = land(made, tmp_path, "out")
    held = state_rows(query)
    # The first batch leaves the rows of twenty keys; in the end only the last row of `other` waits, with its timer.
    assert max(held) >= 20 and held[-1] <= 5


def test_incidents_of_both_passes_equal_batch_once_closed(spark, parts, tmp_path):
    rows, _ = parts
    alerts_in = rows.select("alert_id", "t", "ns", "src", "dst", "proto", "service", "us")
    stream = shuffled(spark, alerts_in, tmp_path, "alerts")
    first, second = jobs.start_incidents(stream.drop("us"), str(tmp_path / "incidents"), 21600.0, 172800.0, delay=DELAY)
    assert first.exception() is None and second.exception() is None
    bursts, campaigns = (spark.read.schema(jobs.CLUSTER_OUT).parquet(str(tmp_path / "incidents" / n)) for n in ("bursts", "campaigns"))
    got = {(r.alert_id, r.incident_id, r.rule) for r in jobs.closed_members(bursts, campaigns).collect()}
    mark = watermark(rows, DELAY_US)
    found = correlate.correlate(alerts(spark, SF), 21600.0, 172800.0)
    want = {(r.alert_id, r.incident_id, r.rule) for r in found.collect()}
    assert got <= want and len({x[2] for x in got}) == 3
    lag = bursts.where("size = 1").agg(F.max("anchor_us")).first()[0] // 1000 * 1000 - 1_000_000
    closed = found.where(F.when(F.col("rule") == "burst", F.col("anchor_us") + BURST_US < mark).otherwise((F.col("anchor_us") + 8 * BURST_US < lag)))
    assert got == {(r.alert_id, r.incident_id, r.rule) for r in closed.collect()}


def test_late_rows_are_kept_and_reconciled(spark, parts, tmp_path):
    rows, _ = parts
    rows = rows.select("key", "alert_id", "us", "t")
    planted = F.pmod(F.xxhash64("alert_id"), F.lit(23)) == 0
    path = str(tmp_path / "planted")
    rows.where(~planted).coalesce(1).write.parquet(path)
    rows.where(planted).union(spark.createDataFrame([("nowhen", 10**9, None, None)], rows.schema)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.land_split(stream, "t", 1.0, str(tmp_path), str(tmp_path / "ck-split")).awaitTermination(120)
    on_time, late = (spark.read.schema(rows.schema).parquet(str(tmp_path / n)) for n in ("on_time", "late"))
    assert on_time.count() + late.count() == rows.count() + 1 and late.count() > 10 and late.where("t is null").count() == 1
    landed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "on_time"))
    got, query = land(jobs.anchored_stream(landed, 21600.0, delay="1 second"), tmp_path, "clusters")
    assert all(o["numRowsDroppedByWatermark"] == 0 for p in query.recentProgress for o in p["stateOperators"])
    mark = watermark(on_time)

    def batch(df):
        made = correlate.anchored_clusters(df, ["key"], 21600.0).groupBy("key", F.col("anchor").alias("anchor_us")).agg(F.count(F.lit(1)).alias("size"))
        return made.where(F.col("anchor_us") + BURST_US < mark)

    streamed = got.select("key", "anchor_us", "size")
    want = sorted(map(tuple, batch(rows).collect()))
    assert sorted(map(tuple, streamed.collect())) != want
    repaired = jobs.reconciled(streamed, on_time, late.where("t is not null"), ["key"], batch)
    assert sorted(map(tuple, repaired.collect())) == want
    assert sorted(map(tuple, jobs.reconciled(repaired, on_time, late.where("t is not null"), ["key"], batch).collect())) == want
