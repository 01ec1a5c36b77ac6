"""Normalisation, rejection and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import normalize as n
from tidewatch.operators import quality
from tidewatch.plans.registry import query
from tidewatch.plans.views import FLOWS_SQL, flows, table
from tidewatch.sources import readers

_F = f"WITH flows AS ({FLOWS_SQL})"


@query("p7_protocols", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'other' END AS protocol FROM events")
def p7_protocols(spark, sf_dir):
    raw = F.expr("case event_type when 'click' then ' TCP' when 'view' then '17' when 'error' then 'icmp' else event_type end")
    return table(spark, sf_dir, "events").select("event_id", n.protocol_name(raw).alias("protocol"))


@query("p2_strict_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS whole, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN o_custkey + 0.5 END AS finite FROM orders")
def p2_strict_numbers(spark, sf_dir):
    text = F.expr("case o_orderkey % 3 when 0 then concat(' ', o_custkey, '.0') when 1 then concat(o_custkey, '.5') else 'inf' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.strict_long(text, 0).alias("whole"), n.finite_double(text).alias("finite"))


@query("p5_timestamps", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE epoch_us(date_trunc('second', o_orderdate)) END AS at_us FROM orders")
def p5_timestamps(spark, sf_dir):
    text = F.expr("case o_orderkey % 4 when 0 then cast(unix_seconds(o_orderdate) as string) when 1 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") when 2 then date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss') else 'soon' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(n.any_timestamp(text)).alias("at_us"))


@query("p9_ports", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey * 40 <= 65535 THEN l_partkey * 40 END AS port FROM lineitem")
def p9_ports(spark, sf_dir):
    text = F.expr("if(l_linenumber % 2 = 0, concat('0x', hex(l_partkey * 40)), cast(l_partkey * 40 as string))")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.port_number(text).alias("port"))


_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_OCT = "CAST(split_part(ip, '.', {i}) AS INT)"
_VALID = " AND ".join(f"{_OCT.format(i=i)} <= 255 AND (split_part(ip, '.', {i}) = '0' OR NOT starts_with(split_part(ip, '.', {i}), '0'))" for i in range(1, 5))
_O1, _O2 = _OCT.format(i=1), _OCT.format(i=2)


@query(
    "p20_addresses",
    rf"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_IPV4}')) AS ip FROM documents), v AS (SELECT ip, {_VALID} AS valid FROM a)
SELECT ip, valid, valid AND ({_O1} IN (0, 10, 127) OR {_O1} >= 224 OR ({_O1} = 172 AND {_O2} BETWEEN 16 AND 31) OR ({_O1} = 192 AND {_O2} = 168) OR ({_O1} = 169 AND {_O2} = 254) OR ({_O1} = 100 AND {_O2} BETWEEN 64 AND 127)
 OR ({_O1} = 198 AND {_O2} IN (18, 19)) OR (ip LIKE '192.0.0.%') OR (ip LIKE '192.0.2.%') OR (ip LIKE '198.51.100.%') OR (ip LIKE '203.0.113.%')) AS special,
 valid AND ({_O1} IN (10, 127) OR ({_O1} = 172 AND {_O2} BETWEEN 16 AND 31) OR ({_O1} = 192 AND {_O2} = 168) OR ({_O1} = 169 AND {_O2} = 254) OR ip = '0.0.0.0') AS private FROM v""",
)
def p20_addresses(spark, sf_dir):
    ips = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IPV4), 0)).alias("ip")).distinct()
    return ips.select("ip", n.is_valid_ipv4(F.col("ip")).alias("valid"), (n.is_valid_ipv4(F.col("ip")) & ~n.is_public_v4(F.col("ip"))).alias("special"), n.is_private_v4(F.col("ip")).alias("private"))


@query("p19_noise", "SELECT event_id, user_id % 6 IN (0, 1, 2, 4) OR user_id % 10 = 3 AS noise FROM events")
def p19_noise(spark, sf_dir):
    src = F.expr("case user_id % 6 when 0 then '224.0.0.251' when 1 then '169.254.3.4' when 2 then '255.255.255.255' when 4 then '10.0.0' else concat('10.0.0.', user_id % 250) end")
    port = F.expr("if(user_id % 10 = 3, 5353, 443)")
    return table(spark, sf_dir, "events").select("event_id", n.is_noise_v4(src, F.lit("10.1.1.1"), port).alias("noise"))


def _routed(spark, sf_dir):
    raw = flows(spark, sf_dir).withColumns({"bwd_packets": F.expr("if(fwd_packets = 7, -1.0, bwd_packets)"), "fwd_packets": F.expr("if(fwd_packets = 9, 0.0, fwd_packets)"), "dst_port": F.expr("if(dst_port % 50 = 0, 70000, dst_port)")})
    return readers.route_rejects(raw, readers.flow_checks())


_REJECT = "CASE WHEN fwd_packets = 7 THEN 'bwd_packets:missing_or_negative' WHEN dst_port % 50 = 0 THEN 'dst_port:out_of_range' WHEN fwd_packets = 9 AND fwd_bytes > 0 THEN 'fwd_bytes:bytes_without_packets' WHEN bwd_packets = 0 AND bwd_bytes > 0 THEN 'bwd_bytes:bytes_without_packets' END"


@query("r1_reject_reasons", f"{_F} SELECT {_REJECT} AS reason, count(*) AS n FROM flows GROUP BY 1")
def r1_reject_reasons(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy(F.concat_ws(":", "rejected.field", "rejected.reason").alias("r")).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("r") != "", F.col("r")).alias("reason"), "n")


@query("a1_quality_report", f"{_F}, r AS (SELECT *, {_REJECT} IS NULL AS ok FROM flows) SELECT count(*) AS total, count_if(ok) AS accepted, count_if(NOT ok) AS rejected, count_if(ok) / count(*) AS rate, (SELECT string_agg(record_id, ',' ORDER BY record_id) FROM (SELECT record_id FROM r WHERE NOT ok ORDER BY record_id LIMIT 20)) AS first FROM r")
def a1_quality_report(spark, sf_dir):
    return quality.quality_report(_routed(spark, sf_dir), "record_id").select("total", "accepted", "rejected", "rate", F.array_join("examples.at", ",").alias("first"))


@query("a2_value_counts", f"{_F} SELECT 'protocol' AS field, protocol AS value, count(*) AS n FROM flows GROUP BY protocol UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM flows GROUP BY label")
def a2_value_counts(spark, sf_dir):
    return quality.value_counts(flows(spark, sf_dir), ["protocol", "label"])


@query("a3_ranges", f"{_F}, l AS (SELECT tuple_key % 4 AS file, 'fwd_bytes' AS field, fwd_bytes AS v FROM flows UNION ALL SELECT tuple_key % 4, 'duration_ms', duration_ms FROM flows) SELECT file, field, min(v) AS low, max(v) AS high, count(*) AS n FROM l GROUP BY GROUPING SETS ((field, file), (field))")
def a3_ranges(spark, sf_dir):
    return quality.ranges(flows(spark, sf_dir).withColumn("file", F.expr("tuple_key % 4")), ["fwd_bytes", "duration_ms"], "file")


@query("a4_bounded_counts", "WITH p AS (SELECT user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY f) AS nth FROM p) SELECT CASE WHEN nth <= 64 THEN user_id END AS user_id, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def a4_bounded_counts(spark, sf_dir):
    return quality.bounded_counts(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("a4_presence", "SELECT 'conv_id' AS field, count(conv_id) AS present FROM conversations UNION ALL SELECT 'turn', count(turn) FROM conversations UNION ALL SELECT 'role', count(role) FROM conversations UNION ALL SELECT 'text', count(text) FROM conversations")
def a4_presence(spark, sf_dir):
    return quality.presence(table(spark, sf_dir, "conversations"))


@query("a5_behaviour", "SELECT user_id, count_if(event_type = 'error') AS failures, count_if(event_type = 'click') AS clicks, count_if(value > 50) AS large FROM events GROUP BY user_id")
def a5_behaviour(spark, sf_dir):
    return quality.behaviour_counts(table(spark, sf_dir, "events"), ["user_id"], {"failures": F.col("event_type") == "error", "clicks": F.col("event_type") == "click", "large": F.col("value") > 50})


@query("a6_session_gates", "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, sum(n) AS rows, list_sort(list(event_type)) AS kinds, count(DISTINCT n) AS sizes FROM p GROUP BY user_id) SELECT count(*) AS sessions, CAST(min(rows) AS BIGINT) AS smallest, bool_and(rows >= 20) AS large_enough, count(DISTINCT kinds) = 1 AS same_kinds, bool_and(sizes = 1) AS equal_counts FROM b")
def a6_session_gates(spark, sf_dir):
    return quality.session_gates(table(spark, sf_dir, "events"), "user_id", "event_type", 20)


@query("a7_intervals", f"{_F} SELECT CASE WHEN label = 0 THEN 'exact' WHEN duration_ms = 0 THEN 'exact' WHEN duration_ms / 1000.0 < 1 THEN 'within_a_second' ELSE 'inconsistent' END AS kind, count(*) AS n FROM flows GROUP BY 1")
def a7_intervals(spark, sf_dir):
    rows = flows(spark, sf_dir).withColumns({"s": F.round(F.col("duration_ms") / 1000.0, 6), "end": F.expr("if(label = 0, timestamp_micros(unix_micros(start_ts) + cast(round(duration_ms * 1000) as bigint)), start_ts)")})
    return rows.groupBy(quality.interval_kinds(F.col("start_ts"), F.col("end"), F.col("s")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("a8_day_counts", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def a8_day_counts(spark, sf_dir):
    return quality.day_label_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@query("p22_parity", f"{_F} SELECT record_id AS id, 'fwd_bytes' AS field, fwd_bytes AS \"left\", fwd_bytes + 1 AS \"right\" FROM flows WHERE tuple_key % 9 = 0")
def p22_parity(spark, sf_dir):
    rows = flows(spark, sf_dir).withColumnRenamed("record_id", "id")
    other = rows.withColumns({"fwd_bytes": F.expr("if(tuple_key % 9 = 0, fwd_bytes + 1, fwd_bytes + 1e-9)")})
    return quality.parity(rows, other, "id", ["fwd_bytes", "bwd_bytes", "duration_ms"])


@query("p23_withheld", f"{_F} SELECT CASE WHEN fwd_packets = 7 THEN 'non_finite:fwd_packets' WHEN label = 1 AND duration_ms = 0 THEN 'non_finite:duration_ms' END AS reason, count(*) AS n FROM flows GROUP BY 1")
def p23_withheld(spark, sf_dir):
    from tidewatch.operators.scoring import withheld_reason

    rows = flows(spark, sf_dir).withColumns({"duration_ms": F.expr("if(label = 1 and duration_ms = 0, double('NaN'), duration_ms)"), "fwd_packets": F.expr("if(fwd_packets = 7, null, fwd_packets)")})
    return rows.groupBy(withheld_reason(["fwd_packets", "duration_ms", "fwd_bytes"]).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p27_hunt_steps", "SELECT 'errors' AS step, count_if(event_type = 'error') AS survivors FROM events UNION ALL SELECT 'large', count_if(event_type = 'error' AND value > 10) FROM events UNION ALL SELECT 'early', count_if(event_type = 'error' AND value > 10 AND user_id < 50) FROM events")
def p27_hunt_steps(spark, sf_dir):
    return quality.sequential_filters(table(spark, sf_dir, "events"), [("errors", F.col("event_type") == "error"), ("large", F.col("value") > 10), ("early", F.col("user_id") < 50)])


@query("p28_raw_units", f"{_F} SELECT record_id, duration_ms / 1000.0 AS duration_s, CAST(protocol = 'tcp' AS INT) AS proto_tcp, CAST(protocol = 'other' AS INT) AS proto_other FROM flows")
def p28_raw_units(spark, sf_dir):
    from tidewatch.operators.scoring import raw_units

    return raw_units(flows(spark, sf_dir)).select("record_id", "duration_s", "proto_tcp", "proto_other")


@query("s6_sensor_routes", "SELECT CASE WHEN event_id % 7 = 0 THEN 'dead_letter' WHEN event_type = 'view' THEN 'flow' ELSE 'skipped' END AS route, CASE WHEN event_id % 7 = 0 THEN 'malformed_json' END AS code, count(*) AS n FROM events GROUP BY ALL")
def s6_sensor_routes(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr(
        "if(event_id % 7 = 0, '{\"broken', to_json(named_struct('timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'flow_id', event_id, 'event_type', if(event_type = 'view', 'flow', event_type), 'src_ip', concat('10.0.0.', user_id % 250), 'dest_ip', '10.1.1.1', 'src_port', 1000, 'dest_port', 443, 'proto', 'TCP', 'flow', named_struct('pkts_toserver', 3, 'pkts_toclient', 2, 'bytes_toserver', 100, 'bytes_toclient', 50, 'age', 1)))) as value"
    )
    return readers.route_sensor_lines(lines).groupBy("route", "code").agg(F.count(F.lit(1)).alias("n"))
