"""Adapters of particular sources: sensor flow lines, scenario rows, benchmark rows, lab sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import normalize as n

#: Fields of a provenance struct, in order; `correlate.rejection_reason` reads it.
PROVENANCE = (
    "entity_namespace_id", "clock_synchronized", "src_entity_id", "dst_entity_id", "protocol", "service_or_port", "observed_at_utc", "validity_start_utc", "validity_end_utc",
    "address_reuse_or_nat", "max_clock_skew_seconds", "source_mode", "entity_role", "clock_origin",
)


def provenance(**fields: Column) -> Column:
    """A provenance struct; fields that are not given are null."""
    kinds = {"clock_synchronized": "boolean", "address_reuse_or_nat": "boolean", "max_clock_skew_seconds": "double"}
    return F.struct(*[fields.get(name, F.lit(None)).cast(kinds.get(name, "string")).alias(name) for name in PROVENANCE])


# ---- sensor flow lines

#: Fields of a sensor's line; numbers come as text, since sensors also write them so.
EVE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("timestamp", "flow_id", "event_type", "src_ip", "dest_ip", "proto", "app_proto", "src_port", "dest_port")),
        T.StructField("alert", T.StructType([T.StructField("signature", T.StringType())])),
        T.StructField("flow", T.StructType([T.StructField(c, T.StringType()) for c in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "age", "start", "end", "state", "reason")])),
    ]
)


def _flow_fields() -> dict[str, Column]:
    """A flow line's values, from its column `eve`."""
    e, f = F.col("eve"), F.col("eve.flow")
    protocol = n.protocol_name(e.proto)

    def port(value: Column) -> Column:
        blank = value.isNull() | (value == "")
        return F.when((protocol == "icmp") & blank, F.lit(0).cast("long")).otherwise(n.strict_long(value, 0, 65535))

    return {
        "protocol": protocol, "src_port": port(e.src_port), "dst_port": port(e.dest_port),
        "start": n.any_timestamp(F.coalesce(F.when(f.start != "", f.start), e.timestamp)), "end": n.any_timestamp(F.coalesce(F.when(f.end != "", f.end), e.timestamp)),
        "fwd_packets": n.strict_long(f.pkts_toserver, 0), "bwd_packets": n.strict_long(f.pkts_toclient, 0), "fwd_bytes": n.strict_long(f.bytes_toserver, 0), "bwd_bytes": n.strict_long(f.bytes_toclient, 0),
    }


def route_sensor_lines(lines: DataFrame, value: str = "value", excerpt: int = 500) -> DataFrame:
    """(value, route, code, excerpt, eve, fields): blank lines are ignored, other events skipped, flow lines kept, and malformed
    or invalid ones routed to the dead letters with a code and an excerpt. Works on batches and streams."""
    text = F.trim(F.col(value))
    parsed = lines.withColumn("eve", F.from_json(text, EVE)).withColumn("_ok", F.expr(f"try_parse_json(trim({value})) is not null"))
    e = F.col("eve")
    parsed = parsed.withColumn("fields", F.struct(*[c.alias(k) for k, c in _flow_fields().items()], n.is_valid_ip(F.coalesce(e.src_ip, F.lit(""))).alias("src_fine"), n.is_valid_ip(F.coalesce(e.dest_ip, F.lit(""))).alias("dst_fine")))
    v = F.col("fields")
    counts = [v[c].isNull() for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")]
    code = (
        F.when(~F.col("_ok"), "malformed_json")
        .when(e.event_type.isNull(), "missing_event_type")
        .when(e.event_type != "flow", None)
        .when(e.flow.isNull(), "invalid_flow")
        .when(~v.src_fine, "invalid_src_ip")
        .when(~v.dst_fine, "invalid_dest_ip")
        .when(F.coalesce(F.trim(e.proto), F.lit("")) == "", "missing_protocol")
        .when(v.src_port.isNull() | v.dst_port.isNull(), "invalid_port")
        .when(counts[0] | counts[1] | counts[2] | counts[3], "invalid_flow")
        .when(v.start.isNull() | v.end.isNull(), "invalid_timestamp")
        .when(v.end < v.start, "end_before_start")
    )
    route = F.when(text == "", "ignored").when(F.col("code").isNotNull(), "dead_letter").when(e.event_type == "flow", "flow").otherwise("skipped")
    return parsed.withColumn("code", F.when(text != "", code)).withColumn("route", route).withColumn("excerpt", F.when(F.col("route") == "dead_letter", F.substring(value, 1, excerpt))).drop("_ok")


def sensor_flow(
    routed: DataFrame, namespace: str = "sensor", representation: str = "sensor_flow_v1", validity_seconds: int = 600, synchronized: bool = True, clock: str = "ntp_synchronized"
) -> DataFrame:
    """Flow rows of routed lines in canonical form, with `features` (ten numbers and four one-hot protocols) and
    `prov` (where and when its end points hold: from the start to `validity_seconds` after the end).

    The duration falls back to `age` seconds where start and end give 0. The event id is the representation and the
    SHA-256 of representation, flow id, start and destination port; a flow without an id is named by its end points."""
    e, names = F.col("eve"), ("protocol", "src_port", "dst_port", "start", "end", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")
    rows = routed.where("route = 'flow'").select(e.src_ip.alias("src"), e.dest_ip.alias("dst"), e.flow_id.alias("_flow_id"), e.flow.age.alias("_age"), *[F.col("fields")[c].alias(c) for c in names])
    span, age = (F.unix_micros("end") - F.unix_micros("start")) / 1000.0, n.finite_double(F.col("_age"), 0.0)
    rows = rows.withColumn("duration_ms", F.when((span == 0) & (age > 0), age * 1000.0).otherwise(span))
    flow_id = F.coalesce("_flow_id", F.concat("src", F.lit(":"), "src_port", F.lit("-"), "dst", F.lit(":"), "dst_port"))
    packets, size = F.col("fwd_packets") + F.col("bwd_packets"), F.col("fwd_bytes") + F.col("bwd_bytes")
    rows = rows.withColumns(
        {
            "flow_id": flow_id,
            "packets_per_second": n.rate_per_second(packets, F.col("duration_ms")), "bytes_per_second": n.rate_per_second(size, F.col("duration_ms")),
            "fwd_packet_length_mean": n.mean_size(F.col("fwd_bytes"), F.col("fwd_packets")), "bwd_packet_length_mean": n.mean_size(F.col("bwd_bytes"), F.col("bwd_packets")),
        }
    )
    numbers = ("duration_ms", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "packets_per_second", "bytes_per_second", "fwd_packet_length_mean", "bwd_packet_length_mean", "dst_port")
    features = F.struct(*[F.col(c).cast("double").alias(c) for c in numbers], *[(F.col("protocol") == p).cast("double").alias(f"protocol_{p}") for p in ("tcp", "udp", "icmp", "other")])
    start = n.iso_utc(F.col("start"))
    until = F.timestamp_micros(F.unix_micros("end") + validity_seconds * 1_000_000)
    prov = provenance(
        entity_namespace_id=F.lit(namespace), clock_synchronized=F.lit(synchronized), src_entity_id=F.concat(F.lit("attacker:"), "src"), dst_entity_id=F.concat(F.lit("victim:"), "dst"),
        protocol=F.col("protocol"), service_or_port=F.col("dst_port"), observed_at_utc=start, validity_start_utc=start, validity_end_utc=n.iso_utc(until), address_reuse_or_nat=F.lit(False),
        max_clock_skew_seconds=F.lit(0.0), source_mode=F.lit("authorized_lab_sensor"), clock_origin=F.lit(clock),
    )
    digest = F.sha2(F.concat_ws(":", F.lit(representation), "flow_id", start, F.col("dst_port").cast("string")), 256)
    return rows.withColumns({"event_id": F.concat(F.lit(f"{representation}:"), digest), "features": features, "prov": prov, "valid_until": until}).drop("_flow_id", "_age")


def follow_lines(lines: DataFrame, value: str = "value", infrastructure: Sequence[str] = ()) -> DataFrame:
    """Rows for `streaming.jobs.signature_stream` from a sensor's mixed lines: (key, us, alert_id, signature): an alert line
    carries its signature, a flow line none; noise is left out, as are lines that are neither.

    The key is the pair of addresses, the protocol and the destination port; alert_id is the line's flow id."""
    e = F.col("eve")
    rows = lines.withColumn("eve", F.from_json(F.trim(F.col(value)), EVE)).where(e.event_type.isin("alert", "flow") & e.src_ip.isNotNull() & e.dest_ip.isNotNull() & e.proto.isNotNull())
    port = F.coalesce(n.strict_long(e.dest_port), F.lit(0))
    signature = F.when(e.event_type == "alert", F.trim(e.alert.signature))
    kept = rows.where(F.when(e.event_type == "alert", F.coalesce(signature, F.lit("")) != "").otherwise(~n.is_noise_v4(e.src_ip, e.dest_ip, port, infrastructure)))
    return kept.select(F.concat_ws("|", e.src_ip, e.dest_ip, F.lower(e.proto), port.cast("string")).alias("key"), F.unix_micros(n.any_timestamp(e.timestamp)).alias("us"), n.strict_long(e.flow_id).alias("alert_id"), signature.alias("signature"))


# ---- scenario rows

#: Names under which scenario rows hold their ends, in order of preference.
SOURCE_NAMES = ("SourceIp", "src_ip", "Computer", "host", "Hostname")
TARGET_NAMES = ("DestinationIp", "dst_ip", "Image", "ProcessName", "TargetFilename", "file_path", "TargetObject", "registry_key", "TargetUserName", "User")
ID_NAMES = ("RecordID", "EventRecordID", "event_id", "source_event_id", "ingestion_id")
TIME_NAMES = ("UtcTime", "@timestamp", "TimeCreated", "timestamp", "observed_at_utc")


def scenario_provenance(raw: DataFrame, scenario: str, role: str = "workstation", clock: str = "utc_event_log", synchronized: bool = True) -> DataFrame:
    """`raw` with source_event_id, observed_at_utc, `prov` and rejected (field and reason, or null) for rows of a replayed scenario.

    Source and target are the first filled of their aliases; a row with a source only is about the host itself
    (`<source>:local_process`). Aliases that `raw` lacks count as empty."""
    if not scenario.strip():
        raise ValueError("the scenario needs a name")

    def have(names: Sequence[str]) -> list[Column]:
        return [F.col(f"`{c}`") for c in names if c in raw.columns] or [F.lit(None).cast("string")]

    event_id, seen = n.first_present(*have(ID_NAMES)), n.any_timestamp(n.first_present(*have(TIME_NAMES)))
    src = n.first_filled(*have(SOURCE_NAMES))
    dst = F.coalesce(n.first_filled(*have(TARGET_NAMES)), F.concat(src, F.lit(":local_process")))
    port = n.first_filled(*have(("DestinationPort", "dst_port", "service_or_port", "Port")), missing=("",))
    mode = F.col("source_mode") if "source_mode" in raw.columns else F.lit("scenario_replay")
    prov = provenance(
        entity_namespace_id=F.lit(f"mordor:{scenario.strip()}"), clock_synchronized=F.lit(synchronized), src_entity_id=src, dst_entity_id=dst,
        protocol=n.protocol_name(n.first_filled(*have(("Protocol", "protocol")), missing=("",))), service_or_port=port, observed_at_utc=n.iso_utc(seen), address_reuse_or_nat=F.lit(False),
        max_clock_skew_seconds=F.lit(0.0), source_mode=F.lit("scenario_replay"), entity_role=F.lit(role), clock_origin=F.lit(clock),
    )
    checks = [
        ("source_mode", "not_a_scenario", F.coalesce(mode, F.lit("")) == "scenario_replay"), ("source_event_id", "missing", event_id.isNotNull()),
        ("observed_at_utc", "missing_or_unreadable", seen.isNotNull()), ("src_entity_id,dst_entity_id", "unresolved", src.isNotNull() & dst.isNotNull()),
    ]
    return raw.withColumns({"source_event_id": event_id, "observed_at_utc": n.iso_utc(seen), "prov": prov, "rejected": n.first_failure(checks)})


# ---- benchmark rows

#: The attack labels that the benchmark's contract knows.
BENCHMARK_ATTACKS = ("FTP-BruteForce", "SSH-Bruteforce", "DoS attacks-GoldenEye", "DoS attacks-Slowloris")


def benchmark_record(raw: DataFrame, file: str = "file", row_no: str = "row_no", attacks: Sequence[str] = BENCHMARK_ATTACKS) -> DataFrame:
    """Feature-only records of processed benchmark rows (text columns): microseconds to milliseconds, strict local times kept
    without a zone, a closed list of labels, derived rates and sizes; `rejected` is the first failing field, or null.

    A label is `Normal` (benign, in any case) or one of `attacks`, exactly; nothing about hosts is made up."""
    c = lambda name: F.col(f"`{name}`")
    label = F.trim(c("Label"))
    values = {
        "duration_ms": n.finite_double(c("Flow Duration"), 0.0) / 1000.0, "fwd_packets": n.strict_long(c("Tot Fwd Pkts"), 0), "bwd_packets": n.strict_long(c("Tot Bwd Pkts"), 0),
        "fwd_bytes": n.strict_long(c("TotLen Fwd Pkts"), 0), "bwd_bytes": n.strict_long(c("TotLen Bwd Pkts"), 0), "dst_port": n.strict_long(c("Dst Port"), 0, 65535),
        "protocol": F.when(F.trim(c("Protocol")) != "", n.protocol_name(c("Protocol"))), "source_timestamp": n.local_timestamp(c("Timestamp")),
        "label": F.when(F.lower(label) == "benign", "Normal").when(label.isin(*attacks), "Attack"), "attack_name": F.when(label.isin(*attacks), label),
        "source_file": F.trim(F.col(file)), "source_row_number": F.col(row_no).cast("long"),
    }
    rows = raw.select(*[v.alias(k) for k, v in values.items()])
    packets, size = F.col("fwd_packets") + F.col("bwd_packets"), F.col("fwd_bytes") + F.col("bwd_bytes")
    rows = rows.withColumns(
        {
            "packets_per_second": n.rate_per_second(packets, F.col("duration_ms")), "bytes_per_second": n.rate_per_second(size, F.col("duration_ms")),
            "fwd_packet_length_mean": n.mean_size(F.col("fwd_bytes"), F.col("fwd_packets")), "bwd_packet_length_mean": n.mean_size(F.col("bwd_bytes"), F.col("bwd_packets")),
        }
    )
    return rows.withColumn("rejected", n.first_failure(record_checks()))


def record_checks() -> list[tuple[str, str, Column]]:
    """The constraints of benchmark records, in the order in which they are told."""
    c = F.col
    checks = [("duration_ms", "not_a_finite_number", c("duration_ms") >= 0)]
    checks += [(f, "not_a_count", c(f) >= 0) for f in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")]
    checks += [("label", "not_approved", c("label").isin("Normal", "Attack")), ("source_file", "not_a_basename", c("source_file").rlike(r"^[^/\\]+$") & ~c("source_file").isin(".", ".."))]
    checks += [("source_row_number", "not_a_row", c("source_row_number") >= 1), ("source_timestamp", "unreadable", c("source_timestamp").isNotNull())]
    checks += [("dst_port", "out_of_range", c("dst_port").between(0, 65535)), ("protocol", "missing", c("protocol").isNotNull())]
    checks += [(f"{way}_bytes", "bytes_without_packets", ~((c(f"{way}_packets") == 0) & (c(f"{way}_bytes") > 0))) for way in ("bwd", "fwd")]
    checks += [("attack_name", "inconsistent", (c("label") == "Attack") == c("attack_name").isNotNull())]
    return checks


# ---- lab sessions

SESSION = T.StructType([T.StructField(f, T.StringType()) for f in ("source_dataset", "event_id", "timestamp", "host", "user", "event_type", "provider", "event_code", "dst_port", "label")])
EVENT_TYPES = ("process", "network", "authentication", "file", "registry", "privilege", "other")


def session_events(lines: DataFrame, value: str = "value", file: str = "file", row_no: str = "row_no", dataset: str = "synthetic_lab") -> DataFrame:
    """Host events of lab session lines (value, file, row_no), with rejected (field and reason, or null).

    A line is one object; its event id must be its own place, `<file>:<row>`, its dataset the lab's and its label Normal;
    it must not carry the names that hold a line's place."""
    text = F.trim(F.col(value))
    variant = F.expr(f"try_parse_json(trim({value}))")
    held = [F.expr(f"try_variant_get(try_parse_json(trim({value})), '$.{f}', 'variant') is null") for f in ("__synthetic_source_file", "__synthetic_source_row")]
    rows = lines.withColumn("event", F.from_json(text, SESSION))
    e = F.col("event")
    checks = [
        ("line", "blank", text != ""), ("line", "invalid_json", variant.isNotNull()), ("line", "not_an_object", F.expr(f"schema_of_variant(try_parse_json(trim({value}))) like 'OBJECT%'")),
        ("line", "reserved_field", F.when(variant.isNotNull(), held[0] & held[1])),
        ("timestamp", "unreadable", n.any_timestamp(e.timestamp).isNotNull()), ("host", "missing", e.host.isNotNull()), ("event_type", "unknown", e.event_type.isin(*EVENT_TYPES)),
        ("dst_port", "out_of_range", e.dst_port.isNull() | n.strict_long(e.dst_port, 0, 65535).isNotNull()),
        ("source_dataset", "not_the_lab", e.source_dataset == dataset), ("event_id", "not_its_place", e.event_id == F.concat(F.col(file), F.lit(":"), F.col(row_no).cast("string"))),
        ("label", "not_normal", e.label == "Normal"),
    ]
    return rows.withColumn("rejected", n.first_failure(checks))
