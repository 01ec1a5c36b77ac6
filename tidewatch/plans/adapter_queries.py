"""Normalisation, adapter, reader, contract and archive queries that the driver's tables can stand in for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import contract
from tidewatch.functions import normalize as n
from tidewatch.operators import audit, correlate, leakage, scoring
from tidewatch.plans.registry import query
from tidewatch.plans.views import FLOWS_SQL, flows, table
from tidewatch.session import shared_dir, stored
from tidewatch.sources import adapters, readers

_F = f"WITH flows AS ({FLOWS_SQL})"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- single values


@query("p1_first_present", "SELECT event_id, CASE WHEN user_id % 4 = 2 THEN 'x' WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS found FROM events")
def p1_first_present(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "case user_id % 4 when 0 then '' when 1 then ' - ' when 2 then ' x' end as a", "if(user_id % 3 = 0, ' NaN ', event_type) as b")
    return rows.select("event_id", n.first_present(F.col("a"), F.col("b")).alias("found"))


@query("p3_at_least", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN value >= 5 THEN value END WHEN 3 THEN 7.5::DOUBLE END AS number FROM events")
def p3_at_least(spark, sf_dir):
    text = F.expr("case event_id % 4 when 0 then cast(value as string) when 1 then concat('-', cast(value + 1 as string)) when 2 then 'inf' else ' 7.5 ' end")
    return table(spark, sf_dir, "events").select("event_id", n.finite_double(text, 5.0).alias("number"))


#: Address texts with (IPv4, IPv6, local); one for each user number modulo their count.
_ADDRESSES = (
    ("10.1.2.3", 1, 0, 1), ("8.8.8.8", 1, 0, 0), ("256.1.1.1", 0, 0, 0), ("fe80::1%eth0", 0, 1, 1), ("::1", 0, 1, 1), ("0:0:0:0:0:0:0:1", 0, 1, 1), ("FC00::12", 0, 1, 1), ("2001:db8::7", 0, 1, 0), ("::ffff:192.168.1.1", 0, 1, 1),
    ("::ffff:8.8.8.8", 0, 1, 0), ("::ffff:a01:203", 0, 1, 1), ("1:2:3:4:5:6:7::", 0, 1, 0), ("1::2::3", 0, 0, 0), ("12345::", 0, 0, 0), ("1:2:3:4:5:6:7:8:9", 0, 0, 0), ("::", 0, 1, 0), ("10.0.0", 0, 0, 0), ("127.0.0.1", 1, 0, 1), ("203.0.113.9", 1, 0, 0),
)
_PICKED = " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(_ADDRESSES))
_FLAGS = {name: f"user_id % {len(_ADDRESSES)} IN ({', '.join(str(i) for i, a in enumerate(_ADDRESSES) if a[k])})" for k, name in ((1, "v4"), (2, "v6"), (3, "local"))}


def _addressed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"case user_id % {len(_ADDRESSES)} {_PICKED} end as ip")


@query("p4_addresses", f"SELECT event_id, {_FLAGS['v4']} AS v4, {_FLAGS['v6']} AS v6 FROM events")
def p4_addresses(spark, sf_dir):
    return _addressed(spark, sf_dir).select("event_id", n.is_valid_ipv4(F.col("ip")).alias("v4"), n.is_ipv6(F.col("ip")).alias("v6"))


@query("p21_local_addresses", f"SELECT event_id, {_FLAGS['local']} AS local FROM events")
def p21_local_addresses(spark, sf_dir):
    return _addressed(spark, sf_dir).select("event_id", n.is_local(F.col("ip")).alias("local"))


@query("p6_local_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS local_time FROM orders")
def p6_local_times(spark, sf_dir):
    text = F.expr("case o_orderkey % 3 when 0 then date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss') when 1 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') else '31/02/2020 00:00:00' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(n.local_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("p13_host_events", "SELECT CASE user_id % 8 WHEN 0 THEN 'process_create' WHEN 1 THEN 'process_create' WHEN 2 THEN 'network_connect' WHEN 3 THEN 'logon_failure' WHEN 4 THEN 'registry' WHEN 5 THEN 'dns' WHEN 6 THEN 'other' ELSE 'unknown' END AS event_kind, count(*) AS n FROM events GROUP BY 1")
def p13_host_events(spark, sf_dir):
    codes = F.expr("case user_id % 8 when 0 then '1' when 1 then ' 4688 ' when 2 then '3.0' when 3 then '4625' when 4 then '13' when 5 then '22' when 6 then '9999' else '1.5' end")
    return readers.host_event(table(spark, sf_dir, "events").select(codes.alias("event_code"))).groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))


# ---- adapters


def _sensor_lines(spark, sf_dir) -> DataFrame:
    """A sensor's line for every event, as stored text; some are broken, end before they start, or come from nowhere."""
    lines = table(spark, sf_dir, "events").selectExpr(
        """if(event_id % 17 = 0, '{"broken', to_json(named_struct('timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'flow_id', event_id, 'event_type', 'flow', 'src_ip', if(event_id % 19 = 0, '300.1.1.1', concat('10.0.0.', user_id % 250)),
 'dest_ip', if(user_id % 2 = 0, '2001:db8::7', '10.1.1.1'), 'src_port', if(user_id % 3 = 0, null, '1000'), 'dest_port', if(user_id % 3 = 0, null, '443'), 'proto', if(user_id % 3 = 0, 'ICMP', 'TCP'),
 'flow', named_struct('pkts_toserver', user_id, 'pkts_toclient', '0', 'bytes_toserver', 100 * user_id, 'bytes_toclient', 0, 'age', 4, 'start', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
 'end', date_format(ts + make_interval(0, 0, 0, 0, 0, 0, if(event_id % 23 = 0, -5, user_id % 2)), "yyyy-MM-dd'T'HH:mm:ss"))))) as value"""
    )
    return stored(lines, "sensor-lines")


_LINES = "CASE WHEN event_id % 17 = 0 THEN 'malformed_json' WHEN event_id % 19 = 0 THEN 'invalid_src_ip' WHEN event_id % 23 = 0 THEN 'end_before_start' END"


@query("s7_dead_letters", f"SELECT code, count(*) AS n FROM (SELECT {_LINES} AS code FROM events) WHERE code IS NOT NULL GROUP BY code")
def s7_dead_letters(spark, sf_dir):
    return readers.route_sensor_lines(_sensor_lines(spark, sf_dir)).where("route = 'dead_letter'").groupBy("code").agg(F.count("excerpt").alias("n"))


@query(
    "p14_sensor_flows",
    f"""WITH e AS (SELECT *, date_trunc('second', ts) AS s, CASE WHEN user_id % 2 = 1 THEN 1000.0::DOUBLE ELSE 4000.0::DOUBLE END AS d, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 443 END AS port FROM events WHERE {_LINES} IS NULL)
SELECT event_id AS flow_id, 'sensor_flow_v1:' || sha256(concat_ws(':', 'sensor_flow_v1', event_id, strftime(s, '%Y-%m-%dT%H:%M:%S') || '+00:00', port)) AS event_id,
 d AS duration_ms, user_id / (d / 1000.0) AS packets_per_second, 100 * user_id / (d / 1000.0) AS bytes_per_second, CASE WHEN user_id > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS fwd_packet_length_mean,
 CASE WHEN user_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS protocol_tcp, CASE WHEN user_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS protocol_icmp,
 'victim:' || CASE WHEN user_id % 2 = 0 THEN '2001:db8::7' ELSE '10.1.1.1' END AS dst_entity, strftime(s + to_seconds(CASE WHEN user_id % 2 = 1 THEN 601 ELSE 600 END), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS valid_until, CAST(NULL AS VARCHAR) AS reject FROM e""",
)
def p14_sensor_flows(spark, sf_dir):
    """Flows of the good lines with their features, provenance and its verdict."""
    made = readers.sensor_flow(readers.route_sensor_lines(_sensor_lines(spark, sf_dir)))
    return made.select(
        F.col("flow_id").cast("long").alias("flow_id"), "event_id", "features.duration_ms", "features.packets_per_second", "features.bytes_per_second", "features.fwd_packet_length_mean",
        "features.protocol_tcp", "features.protocol_icmp", F.col("prov.dst_entity_id").alias("dst_entity"), F.col("prov.validity_end_utc").alias("valid_until"), correlate.rejection_reason().alias("reject"),
    )


@query(
    "p15_scenario_provenance",
    """WITH r AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'host' || user_id ELSE '10.0.0.' || user_id END AS src, CASE WHEN user_id % 5 = 0 THEN 'C:\\x.exe' WHEN user_id % 5 = 1 THEN 'None!' END AS target,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS seen, user_id FROM events),
d AS (SELECT *, coalesce(target, src || ':local_process') AS dst FROM r)
SELECT CAST(event_id AS VARCHAR) AS source_event_id, seen AS observed_at_utc, src AS src_entity, dst AS dst_entity, CASE WHEN user_id % 2 = 0 THEN 'udp' ELSE 'other' END AS protocol, CASE WHEN user_id % 2 = 0 THEN '53' END AS service,
 CASE WHEN user_id % 11 = 0 THEN 'source_mode' WHEN seen IS NULL THEN 'observed_at_utc' WHEN src IS NULL OR dst IS NULL THEN 'src_entity_id,dst_entity_id' END AS rejected FROM d""",
)
def p15_scenario_provenance(spark, sf_dir):
    raw = table(spark, sf_dir, "events").selectExpr(
        "event_id as EventRecordID", "if(user_id % 4 in (0, 1), '-', concat('10.0.0.', user_id)) as SourceIp", "if(user_id % 4 = 1, concat(' host', user_id), ' nan ') as Computer", "'None' as DestinationIp",
        "case user_id % 5 when 0 then 'C:\\\\x.exe' when 1 then 'None!' else '' end as Image", "if(user_id % 7 = 0, 'nan', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")) as UtcTime", "if(user_id % 2 = 0, '17', null) as Protocol",
        "if(user_id % 2 = 0, 53, null) as DestinationPort", "if(user_id % 11 = 0, 'live', 'scenario_replay') as source_mode",
    )
    made = adapters.scenario_provenance(raw, "lab-1")
    return made.select("source_event_id", "observed_at_utc", F.col("prov.src_entity_id").alias("src_entity"), F.col("prov.dst_entity_id").alias("dst_entity"), "prov.protocol", F.col("prov.service_or_port").alias("service"), F.col("rejected.field").alias("rejected"))


def _benchmark_rows(spark, sf_dir) -> DataFrame:
    return flows(spark, sf_dir).selectExpr(
        "cast(duration_ms * 1000 as string) as `Flow Duration`", "if(fwd_packets = 7, '7.5', cast(fwd_packets as string)) as `Tot Fwd Pkts`", "cast(round(bwd_packets) as string) as `Tot Bwd Pkts`",
        "cast(cast(fwd_bytes as long) as string) as `TotLen Fwd Pkts`", "if(dst_port % 9 = 0, '12', '0') as `TotLen Bwd Pkts`", "cast(dst_port as string) as `Dst Port`", "if(label = 1, '6', '17') as Protocol",
        "case dst_port % 6 when 0 then ' BENIGN ' when 1 then 'FTP-BruteForce' when 2 then 'ftp-bruteforce' when 3 then 'DoS attacks-Slowloris' when 4 then 'Infilteration' else 'Benign' end as Label",
        "date_format(start_ts, 'dd/MM/yyyy HH:mm:ss') as Timestamp", "if(dst_port % 13 = 0, 'a/b.csv', 'b.csv') as file", "dst_port as row_no",
    )


_APPROVED = "CASE WHEN dst_port % 6 IN (0, 5) THEN 'Normal' WHEN dst_port % 6 IN (1, 3) THEN 'Attack' END"
_REFUSED = f"""CASE WHEN fwd_packets = 7 THEN 'fwd_packets' WHEN {_APPROVED} IS NULL THEN 'label' WHEN dst_port % 13 = 0 THEN 'source_file' WHEN dst_port < 1 THEN 'source_row_number'
 WHEN bwd_packets = 0 AND dst_port % 9 = 0 THEN 'bwd_bytes' END"""


@query(
    "p12_benchmark_records",
    f"""{_F} SELECT {_REFUSED} AS rejected, {_APPROVED} AS label, CASE dst_port % 6 WHEN 1 THEN 'FTP-BruteForce' WHEN 3 THEN 'DoS attacks-Slowloris' END AS attack_name, count(*) AS n,
 CAST(sum(CASE WHEN fwd_packets <> 7 THEN CAST(trunc(fwd_bytes) AS BIGINT) ELSE 0 END) AS BIGINT) AS fwd_bytes, round(max(duration_ms), 6) AS longest FROM flows GROUP BY ALL""",
)
def p12_benchmark_records(spark, sf_dir):
    made = adapters.benchmark_record(_benchmark_rows(spark, sf_dir))
    bytes_ = F.sum(F.when(F.col("fwd_packets").isNotNull(), F.col("fwd_bytes")).otherwise(0))
    return made.groupBy(F.col("rejected.field").alias("rejected"), "label", "attack_name").agg(F.count(F.lit(1)).alias("n"), bytes_.alias("fwd_bytes"), F.round(F.max("duration_ms"), 6).alias("longest"))


@query("p16_record_constraints", f"{_F}, r AS (SELECT CASE WHEN dst_port % 10 = 1 THEN 'duration_ms:not_a_finite_number' WHEN dst_port % 10 = 2 THEN 'dst_port:out_of_range' WHEN dst_port % 10 = 3 AND fwd_bytes > 0 THEN 'fwd_bytes:bytes_without_packets' WHEN dst_port % 10 = 4 THEN 'attack_name:inconsistent' END AS reason FROM flows) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def p16_record_constraints(spark, sf_dir):
    rows = flows(spark, sf_dir).selectExpr(
        "if(dst_port % 10 = 1, -1.0, duration_ms) as duration_ms", "if(dst_port % 10 = 3, 0, fwd_packets) as fwd_packets", "1 as bwd_packets", "fwd_bytes", "bwd_bytes", "if(dst_port % 10 = 2, 70000, dst_port) as dst_port", "protocol",
        "'Attack' as label", "if(dst_port % 10 = 4, null, 'a') as attack_name", "'f.csv' as source_file", "1 as source_row_number", "start_ts as source_timestamp",
    )
    told = readers.route_rejects(rows, adapters.record_checks()).withColumn("reason", F.concat("rejected.field", F.lit(":"), "rejected.reason"))
    return told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- the contract

_CONTRACT_SQL = f"""{_F}, c AS (SELECT record_id, duration_ms, CAST(fwd_packets AS BIGINT) AS fwd_packets, CAST(bwd_packets AS BIGINT) AS bwd_packets, CAST(trunc(fwd_bytes) AS BIGINT) AS fwd_bytes, CAST(trunc(bwd_bytes) AS BIGINT) AS bwd_bytes,
 CAST(dst_port AS BIGINT) AS dst_port, protocol FROM flows),
p AS (SELECT record_id, duration_ms, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, CASE WHEN duration_ms > 0 THEN (fwd_packets + bwd_packets) / (duration_ms / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END AS packets_per_second,
 CASE WHEN duration_ms > 0 THEN (fwd_bytes + bwd_bytes) / (duration_ms / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END AS bytes_per_second, CASE WHEN fwd_packets > 0 THEN fwd_bytes / fwd_packets ELSE 0.0::DOUBLE END AS fwd_packet_length_mean,
 CASE WHEN bwd_packets > 0 THEN bwd_bytes / bwd_packets ELSE 0.0::DOUBLE END AS bwd_packet_length_mean, dst_port, protocol FROM c)"""


def _contracted(spark, sf_dir) -> DataFrame:
    counts = {c: F.col(c).cast("long") for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "dst_port")}
    return scoring.with_features(flows(spark, sf_dir).withColumns(counts))


@query("p17_projection", f"{_CONTRACT_SQL} SELECT * FROM p")
def p17_projection(spark, sf_dir):
    return contract.project(_contracted(spark, sf_dir), keep=["record_id"])


def _typed(name: str, kind: str) -> str:
    head = f"'{len(name):08x}' || hex(encode('{name}')) || "
    if kind == "integer":
        return head + f"'69' || hex({name}::BIT::BLOB)"
    if kind == "float":
        return head + f"'66' || hex(CAST({name} AS DOUBLE)::BIT::BLOB)"
    return head + f"'73' || printf('%08x', strlen({name})) || hex(encode({name}))"


@query("d2_feature_fingerprints", f"{_CONTRACT_SQL} SELECT record_id, sha256(unhex(hex(encode('tidewatch:features')) || '00' || {' || '.join(_typed(*c) for c in contract.CONTRACT)})) AS fingerprint FROM p")
def d2_feature_fingerprints(spark, sf_dir):
    return _contracted(spark, sf_dir).select("record_id", contract.feature_fingerprint("tidewatch:features").alias("fingerprint"))


_CATEGORIES = ("Fuzzers", "DoS", "Reconnaissance")


@query(
    "d16_training_frame",
    f"""{_F}, r AS (SELECT *, CASE WHEN duration_ms > 0 THEN (fwd_packets + bwd_packets) / (duration_ms / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
 CASE dst_port % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS category_id FROM flows WHERE dst_port % 17 <> 3 AND dst_port % 19 <> 4)
SELECT CASE WHEN label = 0 THEN 'Normal' WHEN category_id = 0 THEN 'Fuzzers' WHEN category_id = 1 THEN 'DoS' ELSE 'Reconnaissance' END AS stratum, label AS y, category_id, count(*) AS n, round(sum(rate) / count(*), 4) AS mean_rate
FROM r WHERE label = 0 OR category_id >= 0 GROUP BY ALL""",
)
def d16_training_frame(spark, sf_dir):
    raw = flows(spark, sf_dir).selectExpr(
        "cast(duration_ms / 1000.0 as string) as dur", "cast(fwd_packets as string) as spkts", "cast(bwd_packets as string) as dpkts", "if(dst_port % 17 = 3, 'n/a', cast(fwd_bytes as string)) as sbytes",
        "if(dst_port % 19 = 4, 'inf', ' 1 ') as stime", "cast(label as string) as label", "case dst_port % 5 when 0 then ' fuzzers' when 1 then 'DOS ' when 2 then 'reconnaissance' when 3 then 'unknown' end as attack_cat",
    )
    made = leakage.training_frame(raw, ["dur", "spkts", "dpkts", "sbytes", "rate"], _CATEGORIES, required=["stime"])
    return made.groupBy("stratum", "y", "category_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate") / F.count(F.lit(1)), 4).alias("mean_rate"))


# ---- readers and sinks, over files written from a table


@query("s1_preflight", "SELECT count(*) AS rows, 'amount' AS missing, '3' AS widths FROM orders")
def s1_preflight(spark, sf_dir):
    """A headered CSV of the orders whose note holds a comma and a quote."""
    path = _folder(spark, "s1")
    table(spark, sf_dir, "orders").selectExpr("o_orderkey as Id", "concat('a, \"b\" ', o_orderstatus) as note", "o_custkey as customer").write.option("header", True).option("escape", '"').csv(path)
    found = readers.preflight_csv(spark, path, {"id": ["ID", "key"], "amount": ["amount", "sum"], "customer": ["customer"]})
    return found.select("rows", F.array_join("missing", ",").alias("missing"), F.array_join(F.col("widths").cast("array<string>"), ",").alias("widths"))


@query("s2_numbered_rows", "SELECT count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS customers, true AS gapless, 0 AS out_of_order FROM orders")
def s2_numbered_rows(spark, sf_dir):
    """Headerless CSV of the orders, ordered by key within each file: row numbers have no gap and follow the order."""
    path = _folder(spark, "s2")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(4, "o_custkey").sortWithinPartitions("o_orderkey").write.csv(path)
    rows = readers.with_row_numbers(readers.read_headerless(spark, [path], ["o_orderkey", "o_custkey"]))
    rows = rows.select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").cast("long").alias("customer"), "file", "row_no")
    per = rows.groupBy("file").agg((F.count_distinct("row_no") == F.count(F.lit(1))).alias("a"), (F.max("row_no") == F.count(F.lit(1))).alias("b"))
    after = rows.alias("x").join(rows.alias("y"), F.expr("x.file = y.file and x.row_no + 1 = y.row_no")).agg(F.count_if(F.expr("x.key > y.key")).alias("out_of_order"))
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("customer").alias("customers")).crossJoin(per.agg(F.bool_and(F.col("a") & F.col("b")).alias("gapless")))
    return whole.crossJoin(after)


@query("s3_any_header_order", "SELECT o_orderstatus AS status, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY o_orderstatus")
def s3_any_header_order(spark, sf_dir):
    """Headered CSV files of the orders whose columns come in two different orders."""
    path = _folder(spark, "s3")
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey as customer", "concat(o_orderstatus, ', x') as status", "o_orderkey as id")
    orders.where("id % 2 = 0").write.option("header", True).csv(path)
    orders.where("id % 2 = 1").select("id", "status", "customer").write.option("header", True).mode("append").csv(path)
    rows = readers.read_headered(spark, path, ["id", "customer", "status"])
    return rows.groupBy(F.split("status", ",")[0].alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("customer").cast("long")).alias("customers"))


@query("s9_pruned_columns", "SELECT CAST(sum(o_custkey) AS BIGINT) AS customers, count(*) AS rows FROM orders")
def s9_pruned_columns(spark, sf_dir):
    """One of four columns of a headerless CSV; the scan reads no other."""
    path = _folder(spark, "s9")
    table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice").write.csv(path)
    rows = readers.read_headerless(spark, [path], ["id", "status", "customer", "price"], ["customer"])
    return rows.agg(F.sum(F.col("customer").cast("long")).alias("customers"), F.count(F.lit(1)).alias("rows"))


@query("s4_json_lines", "SELECT CASE user_id % 6 WHEN 0 THEN 'blank' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'reserved_field' END AS issue, count(*) AS n FROM events GROUP BY 1")
def s4_json_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("case user_id % 6 when 0 then '  ' when 1 then '{\"a\": ' when 2 then '[1, 2]' when 3 then to_json(named_struct('_id', event_id)) else to_json(named_struct('id', event_id, 'type', event_type)) end as value")
    return readers.classify_json_lines(lines, reserved=["_id"]).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s5_session_events",
    """SELECT CASE user_id % 12 WHEN 0 THEN 'line:blank' WHEN 1 THEN 'line:invalid_json' WHEN 2 THEN 'line:not_an_object' WHEN 3 THEN 'line:reserved_field' WHEN 4 THEN 'event_id:not_its_place' WHEN 5 THEN 'label:not_normal'
 WHEN 6 THEN 'source_dataset:not_the_lab' WHEN 7 THEN 'dst_port:out_of_range' WHEN 8 THEN 'event_type:unknown' END AS reason, count(*) AS n FROM events GROUP BY 1""",
)
def s5_session_events(spark, sf_dir):
    fields = "'source_dataset', if(user_id % 12 = 6, 'other', 'synthetic_lab'), 'event_id', if(user_id % 12 = 4, 'x:1', concat(file, ':', row_no)), 'timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'host', concat('h', user_id), 'event_type', if(user_id % 12 = 8, 'dance', 'process'), 'dst_port', if(user_id % 12 = 7, 70000, 443), 'label', if(user_id % 12 = 5, 'Attack', 'Normal')"
    rows = table(spark, sf_dir, "events").selectExpr("*", "concat('s', user_id % 7, '.ndjson') as file", "event_id + 1 as row_no")
    lines = rows.selectExpr("file", "row_no", f"case user_id % 12 when 0 then ' ' when 1 then '{{oops' when 2 then '[]' when 3 then to_json(named_struct('__synthetic_source_row', 1, {fields})) else to_json(named_struct({fields})) end as value")
    told = adapters.session_events(lines).withColumn("reason", F.concat("rejected.field", F.lit(":"), "rejected.reason"))
    return told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s10_assignments", "SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def s10_assignments(spark, sf_dir):
    path = _folder(spark, "s10")
    orders = table(spark, sf_dir, "orders")
    readers.write_assignments(orders.selectExpr("o_orderkey", "if(o_orderkey % 5 = 0, 'validation', 'train') as disposition"), path, ["o_orderkey"], orders.count())
    back = spark.read.schema("o_orderkey long, disposition string").option("header", True).csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("s11_matrices", f"{_F} SELECT CASE WHEN start_ts < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'validation' END AS disposition, count(*) AS rows, round(sum(fwd_packets), 3) AS packets FROM flows GROUP BY 1")
def s11_matrices(spark, sf_dir):
    path = _folder(spark, "s11")
    readers.write_matrices(flows(spark, sf_dir).withColumn("disposition", F.expr("if(start_ts < '1996-01-01', 'train', 'validation')")), path, ["duration_ms", "fwd_packets"])
    return spark.read.parquet(path).groupBy("disposition").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("fwd_packets"), 3).alias("packets"))


@query("s12_report", "SELECT count(*) AS rows, CAST(sum(user_id) AS BIGINT) AS users FROM events")
def s12_report(spark, sf_dir):
    path = _folder(spark, "s12")
    readers.write_report(table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("rows"), F.sum("user_id").alias("users")), path)
    return spark.read.schema("rows long, users long").json(path)


_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("s14_archive_export", f"SELECT count(*) AS rows, (SELECT event_id FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000) ORDER BY ts, event_id LIMIT 1) AS first_id, (SELECT event_id FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000) ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_id, true AS same FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000)")
def s14_archive_export(spark, sf_dir):
    """The manifest of an exported prefix; `same` compares its digest with the table's own."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    at, last = F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(5000)
    manifest = audit.export_archive(rows, _folder(spark, "s14"), "ts", "event_id", at, last)
    own = audit.archive_digest(audit.archive_up_to(rows, "ts", "event_id", at, last), rows.columns).select(F.col("xor").alias("_xor"), F.col("sum").alias("_sum"))
    return manifest.crossJoin(own).select("rows", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), ((F.col("xor") == F.col("_xor")) & (F.col("sum") == F.col("_sum"))).alias("same"))


@query("s13_manifest", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'verified' WHEN n_nationkey % 4 = 1 THEN 'mismatch' WHEN n_nationkey % 4 = 2 THEN 'unregistered' ELSE 'too_large' END AS status FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'missing' ELSE 'optional_missing' END FROM nation) GROUP BY status")
def s13_manifest(spark, sf_dir):
    """One file a nation with its orders' keys; the manifest knows some, has other digests for some, and lists files that do not exist."""
    path = _folder(spark, "s13")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey as nation")
    keys = table(spark, sf_dir, "nation").selectExpr("n_nationkey as nation", "cast(n_nationkey as string) as value")
    keys = keys.unionByName(table(spark, sf_dir, "orders").join(customers, "o_custkey").selectExpr("nation", "cast(o_orderkey as string) as value"))
    # Values of every fourth nation are padded as far as makes its file larger than those of the others, whatever their number.
    sizes = keys.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value") + 1).alias("bytes"))
    most = sizes.where("nation % 4 <> 3").agg(F.max("bytes")).first()[0] or 0
    width = sizes.where("nation % 4 = 3").select(F.col("nation"), F.ceil((F.lit(most) + 1) / F.col("n")).cast("int").alias("width"))
    keys = keys.join(F.broadcast(width), "nation", "left")  # a row a nation
    keys = keys.select("nation", F.expr("if(width is null, value, rpad(value, greatest(width, length(value)), ' '))").alias("value"))
    keys.repartition("nation").sortWithinPartitions("value").write.partitionBy("nation").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = [F.element_at(F.split("path", "/"), -1).alias("part"), F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")]
    have = files.select(*named, "content").where("nation % 4 <> 3").select("part", "nation", F.sha2("content", 256).alias("sha256"))
    # What is too large to be verified is not read whole for the manifest either.
    large = readers.streamed_digests(files.select("path", *named).where("nation % 4 = 3").select("path", "part", "nation"))
    have = have.unionByName(large.select("part", "nation", F.coalesce("found", F.repeat(F.lit("0"), F.lit(64))).alias("sha256")))
    names = F.concat(F.lit("nation="), "nation", F.lit("/"), "part")
    known = have.where("nation % 4 <> 2").select(names.alias("file"), F.when(F.col("nation") % 4 == 1, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("sha256")).alias("sha256"), F.lit(True).alias("required"))
    gone = table(spark, sf_dir, "nation").selectExpr("concat('gone-', n_nationkey) as file", "repeat('1', 64) as sha256", "n_nationkey % 2 = 0 as required")
    largest = files.select(*named, "length").where("nation % 4 <> 3").agg(F.max("length")).first()[0]
    return readers.verify_manifest(spark, path, known.unionByName(gone), largest, depth=2, streamed=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))



@query("s13_streamed_digests", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM nation) GROUP BY status")
def s13_streamed_digests(spark, sf_dir):
    """One file a nation with its customers' keys, all of them streamed; the manifest has another digest for every third."""
    path = _folder(spark, "s13-streamed")
    keys = table(spark, sf_dir, "nation").selectExpr("n_nationkey as nation", "cast(n_nationkey as string) as value")
    keys = keys.unionByName(table(spark, sf_dir, "customer").selectExpr("c_nationkey as nation", "cast(c_custkey as string) as value"))
    keys.repartition("nation").sortWithinPartitions("value").write.partitionBy("nation").text(path)
    # The digests of the manifest come from the files' contents read whole.
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    known = have.select(name.alias("file"), F.when(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int") % 3 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)).alias("sha256"), F.lit(True).alias("required"))
    return readers.verify_manifest(spark, path, known, largest=0, depth=2).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_FAN = 64
_ENTRIES_SQL = f"""e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE ts < {_CUT} OR (ts = {_CUT} AND event_id <= 5000)),
l AS (SELECT seq, sha256(concat_ws('|', CAST(seq AS VARCHAR), '=' || event_id, '=' || user_id, '=' || event_type)) AS leaf FROM e),
b0 AS (SELECT (seq - 1) // {_FAN} AS block, sha256('0:' || string_agg(leaf, '' ORDER BY seq)) AS digest FROM l GROUP BY 1),
""" + ", ".join(f"b{i} AS (SELECT block // {_FAN} AS block, sha256('1:' || string_agg(digest, '' ORDER BY block)) AS digest FROM b{i - 1} GROUP BY 1)" for i in (1, 2, 3, 4))


@query("s14_sealed_archive", f"WITH {_ENTRIES_SQL} SELECT (SELECT count(*) FROM e) AS rows, CASE WHEN (SELECT count(*) FROM b0) = 1 THEN (SELECT max(digest) FROM b0) WHEN (SELECT count(*) FROM b1) = 1 THEN (SELECT max(digest) FROM b1) WHEN (SELECT count(*) FROM b2) = 1 THEN (SELECT max(digest) FROM b2) ELSE (SELECT max(digest) FROM b3) END AS root")
def s14_sealed_archive(spark, sf_dir):
    """The root of an archive's entries in order, from the files as they are read back."""
    rows = table(spark, sf_dir, "events")
    at, last = F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(5000)
    path = _folder(spark, "s14-sealed")
    audit.export_sealed(rows.select("event_id", "ts", "user_id", "event_type"), path, "ts", "event_id", at, last, fan=_FAN)
    back = audit.read_sealed(rows.select("event_id", "ts", "user_id", "event_type"), path)
    return audit.digest_root(audit.digest_blocks(back, "seq", audit.entry_leaf("seq", ["event_id", "user_id", "event_type"]), _FAN), _FAN)


@query(
    "p10_seconds_flows",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS INTEGER) AS dst_port, l_discount * 1000.0 AS duration_ms, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS fwd_packets, epoch_us(l_shipdate) AS start_us,
 CASE WHEN l_orderkey % 13 = 0 THEN 'fwd_packets' END AS rejected FROM lineitem""",
)
def p10_seconds_flows(spark, sf_dir):
    """Text rows with durations in seconds and ports in decimal or hexadecimal, to canonical flows; some packet counts are no numbers."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_partkey as string) as srcip", "'10.0.0.1' as dstip", "'1024' as sport", "if(l_linenumber % 2 = 0, concat('0x', hex(l_suppkey)), cast(l_suppkey as string)) as dsport", "' TCP' as proto",
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') as stime", "cast(cast(l_discount as double) as string) as dur", "if(l_orderkey % 13 = 0, 'many', cast(cast(l_quantity as bigint) as string)) as spkts", "'3' as dpkts", "'100' as sbytes", "'50' as dbytes", "'1' as label",
    )
    names = {"src": ["srcip"], "dst": ["dstip"], "src_port": ["sport"], "dst_port": ["dsport"], "protocol": ["proto"], "start": ["stime"], "duration": ["dur"], "fwd_packets": ["spkts"], "bwd_packets": ["dpkts"], "fwd_bytes": ["sbytes"], "bwd_bytes": ["dbytes"], "label": ["label"]}
    found = readers.route_rejects(readers.canonical_flow(raw, names, 1000.0), readers.flow_checks())
    return found.select("l_orderkey", "l_linenumber", "src", F.col("dst_port").cast("int").alias("dst_port"), "duration_ms", "fwd_packets", F.unix_micros("start").alias("start_us"), F.col("rejected.field").alias("rejected"))


@query(
    "p11_microseconds_flows",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'udp' ELSE 'tcp' END AS protocol, floor(l_extendedprice) * 0.001 AS duration_ms, CAST(l_linenumber AS BIGINT) AS fwd_packets, CASE WHEN l_orderkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(4 AS BIGINT) END AS bwd_packets,
 CASE WHEN l_orderkey % 17 = 0 THEN 'bwd_bytes' END AS rejected FROM lineitem""",
)
def p11_microseconds_flows(spark, sf_dir):
    """Text rows of the other benchmark: durations in microseconds, protocols by number, names with spaces; some have bytes without packets."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "if(l_linenumber % 5 = 0, '17', '6') as `Protocol`", "cast(cast(floor(l_extendedprice) as bigint) as string) as `Flow Duration`", "cast(l_linenumber as string) as `Tot Fwd Pkts`",
        "if(l_orderkey % 17 = 0, '0', '4') as `Tot Bwd Pkts`", "'10' as `TotLen Fwd Pkts`", "'20' as `TotLen Bwd Pkts`", "'443' as `Dst Port`",
    )
    names = {"dst_port": ["Dst Port"], "protocol": ["Protocol"], "duration": ["Flow Duration"], "fwd_packets": ["Tot Fwd Pkts"], "bwd_packets": ["Tot Bwd Pkts"], "fwd_bytes": ["TotLen Fwd Pkts"], "bwd_bytes": ["TotLen Bwd Pkts"]}
    found = readers.route_rejects(readers.canonical_flow(raw, names, 0.001), readers.flow_checks())
    return found.select("l_orderkey", "l_linenumber", "protocol", "duration_ms", "fwd_packets", "bwd_packets", F.col("rejected.field").alias("rejected"))
