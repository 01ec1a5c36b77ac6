"""Contracts, fingerprints, adapters, embeddings and published figures, by literal values."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import contract
from tidewatch.functions import normalize as n
from tidewatch.operators import correlate, leakage, scoring, text
from tidewatch.sources import adapters, readers


def test_contract_guard_and_projection(spark):
    names = [c for c, _ in contract.CONTRACT]
    contract.check_model_fields(names)
    with pytest.raises(ValueError, match="forbidden model fields: label, src_ip"):
        contract.check_model_fields([*names, "src_ip", "label"])
    for wrong in (names[:-1], names[::-1], [*names, "extra"]):
        with pytest.raises(ValueError, match="not those of the contract"):
            contract.check_model_fields(wrong)
    df = spark.createDataFrame([(*range(10), "tcp", "10.0.0.1", 1)], [*names, "src_ip", "label"])
    assert contract.project(df).columns == names
    assert contract.project(df.select("label", *names[::-1]), keep=["label"]).columns == ["label", *names]
    with pytest.raises(ValueError, match="missing: protocol"):
        contract.project(df.drop("protocol"))


def test_feature_fingerprint_bytes(spark):
    rows = [(1, 1.5, 3, "tcp"), (2, -0.0, -7, "é"), (3, float("nan"), 1, "x"), (4, None, 1, "x"), (5, 0.0, -7, "é")]
    kinds = [("a", "float"), ("count", "integer"), ("kind", "category")]
    got = dict(spark.createDataFrame(rows, "id int, a double, count long, kind string").select("id", contract.feature_fingerprint("d:v1", kinds)).collect())

    def plain(a, count, kind):
        name = lambda x: struct.pack(">I", len(x)) + x
        return hashlib.sha256(b"d:v1\0" + name(b"a") + b"f" + struct.pack(">d", a) + name(b"count") + b"i" + struct.pack(">q", count) + name(b"kind") + b"s" + name(kind.encode())).hexdigest()

    assert got[1] == plain(1.5, 3, "tcp") and got[2] == plain(-0.0, -7, "é") != got[5] == plain(0.0, -7, "é")
    assert got[3] is None and got[4] is None


ADDRESSES = {
    "1.2.3.4": "v4", "01.2.3.4": "", "::": "v6", "::1": "v6 local", "1::": "v6", "1:2:3:4:5:6:7:8": "v6", "1:2:3:4:5:6:7": "", "1:2:3:4:5:6:1.2.3.4": "v6", "::1.2.3.4": "v6", "1:2:3:4:5:6:7:1.2.3.4": "", "::1.2.3": "",
    "g::1": "", ":::": "", "1:::2": "", ":1": "", "1:": "", "fe80::1%en0": "v6 local", "FD12:3456::1": "v6 local", "fe00::1": "v6", "febf::1": "v6 local", "fec0::1": "v6", "::ffff:10.0.0.1": "v6 local", "::ffff:7f00:1": "v6 local",
    "::ffff:203.0.113.5": "v6", "203.0.113.5": "v4", "172.31.0.1": "v4 local", "172.32.0.1": "v4", "169.254.1.1": "v4 local", " 192.168.0.9 ": "local", "": "", "0x7f.1": "", "[::1]": "", "2001:db8::": "v6", "0:0:0:0:0:0:0:1": "v6 local", "0::0:0001": "v6 local",
}


def test_addresses_of_both_versions(spark):
    df = spark.createDataFrame([(a,) for a in [*ADDRESSES, None]], "ip string")
    got = {r.ip: " ".join(w for w, yes in (("v4", r.v4), ("v6", r.v6), ("local", r.local)) if yes) for r in df.select("ip", n.is_valid_ipv4(F.col("ip")).alias("v4"), n.is_ipv6(F.col("ip")).alias("v6"), n.is_local(F.col("ip")).alias("local")).collect()}
    assert got.pop(None) == "" and got == ADDRESSES


def flow_line(**more):
    flow = {"pkts_toserver": 3, "pkts_toclient": "2", "bytes_toserver": 300, "bytes_toclient": 200, "age": 4, "start": "2024-01-01T00:00:01.250000+0000", "end": "2024-01-01T00:00:03.250000+0000"} | more.pop("flow", {})
    return {"timestamp": "2024-01-01T00:00:05Z", "flow_id": 7, "event_type": "flow", "src_ip": "10.0.0.5", "dest_ip": "fe80::6", "src_port": "5000", "dest_port": 443, "proto": "TCP", "flow": flow} | more


def test_sensor_flow_features_and_provenance(spark):
    lines = [flow_line(), flow_line(flow={"end": "2024-01-01T00:00:01.250000+0000"}, flow_id=None), flow_line(proto="ICMP", src_port=None, dest_port="", flow={"start": None, "end": None})]
    bad = [flow_line(dest_ip="12:34"), flow_line(src_port=None), flow_line(dest_port=70000), flow_line(flow={"bytes_toclient": -1}), flow_line(flow={"end": "2024-01-01T00:00:00Z"}), flow_line(proto=" "), flow_line(flow={"start": "soon"})]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines + bad], "value string")
    routed = readers.route_sensor_lines(df)
    assert sorted(r.code for r in routed.where("route = 'dead_letter'").collect()) == sorted(["invalid_dest_ip", "invalid_port", "invalid_port", "invalid_flow", "end_before_start", "missing_protocol", "invalid_timestamp"])
    one, two, three = readers.sensor_flow(routed, namespace="ns", synchronized=True).withColumn("reject", correlate.rejection_reason()).orderBy("protocol", F.desc("flow_id")).collect()[1:] + readers.sensor_flow(routed).where("protocol = 'icmp'").withColumn("reject", F.lit(None)).collect()
    by = {r.flow_id: r for r in (one, two)}
    first = by["7"]
    assert first.features.asDict() == {
        "duration_ms": 2000.0, "fwd_packets": 3.0, "bwd_packets": 2.0, "fwd_bytes": 300.0, "bwd_bytes": 200.0, "packets_per_second": 2.5, "bytes_per_second": 250.0, "fwd_packet_length_mean": 100.0,
        "bwd_packet_length_mean": 100.0, "dst_port": 443.0, "protocol_tcp": 1.0, "protocol_udp": 0.0, "protocol_icmp": 0.0, "protocol_other": 0.0,
    }
    assert first.prov.observed_at_utc == first.prov.validity_start_utc == "2024-01-01T00:00:01.250000+00:00" and first.prov.validity_end_utc == "2024-01-01T00:10:03.250000+00:00"
    assert (first.prov.src_entity_id, first.prov.dst_entity_id, first.prov.service_or_port, first.prov.entity_namespace_id, first.reject) == ("attacker:10.0.0.5", "victim:fe80::6", "443", "ns", None)
    assert first.event_id == "sensor_flow_v1:" + hashlib.sha256(b"sensor_flow_v1:7:2024-01-01T00:00:01.250000+00:00:443").hexdigest()
    assert by["10.0.0.5:5000-fe80::6:443"].duration_ms == 4000.0  # by age, since start and end give 0
    assert (three.src_port, three.dst_port, three.prov.observed_at_utc) == (0, 0, "2024-01-01T00:00:05+00:00")


def test_scenario_provenance(spark):
    rows = [
        ("5", None, "2024-01-01T00:00:00", " WS1 ", None, None, "17", "53", "scenario_replay"), (None, "9", "1704067200.5", "-", "10.0.0.1", "10.0.0.2", None, None, "scenario_replay"),
        ("5", None, "2024-01-01", "NONE", "nan", "None", "tcp", "", "scenario_replay"), ("6", None, "never", "a", None, None, None, None, "scenario_replay"), (None, "none", "2024-01-01", "a", None, None, None, None, "scenario_replay"),
        ("7", None, "2024-01-01", "", None, "b", None, None, "scenario_replay"), ("8", None, "2024-01-01", "a", None, "b", None, None, "live"),
    ]
    df = spark.createDataFrame(rows, "RecordID string, event_id string, UtcTime string, Hostname string, SourceIp string, DestinationIp string, Protocol string, DestinationPort string, source_mode string")
    got = [(r.source_event_id, r.prov.src_entity_id, r.prov.dst_entity_id, r.prov.protocol, r.prov.service_or_port, r.observed_at_utc, r.rejected and r.rejected.field) for r in adapters.scenario_provenance(df, " demo ").collect()]
    assert got[0] == ("5", "WS1", "WS1:local_process", "udp", "53", "2024-01-01T00:00:00+00:00", None)
    assert got[1] == ("9", "10.0.0.1", "10.0.0.2", "other", None, "2024-01-01T00:00:00.500000+00:00", None)
    assert got[2][1:5] == ("NONE", "NONE:local_process", "tcp", None)  # the markers of a missing entity are read in their exact case
    assert [g[-1] for g in got[3:]] == ["observed_at_utc", "source_event_id", "src_entity_id,dst_entity_id", "source_mode"]
    assert adapters.scenario_provenance(df, "demo").first().prov.entity_namespace_id == "mordor:demo"
    with pytest.raises(ValueError):
        adapters.scenario_provenance(df, " ")


def test_benchmark_records(spark):
    good = {"Flow Duration": "1500", "Tot Fwd Pkts": "2", "Tot Bwd Pkts": "0", "TotLen Fwd Pkts": "100", "TotLen Bwd Pkts": "0", "Dst Port": "80", "Protocol": "6", "Label": "Benign", "Timestamp": "14/02/2018 08:31:01", "file": "a.csv", "row_no": "1"}
    rows = [good, good | {"Label": "BENIGN"}, good | {"Label": "SSH-Bruteforce"}, good | {"Label": "ssh-bruteforce"}, good | {"Timestamp": "2018-02-14 08:31:01"}, good | {"TotLen Bwd Pkts": "5"}, good | {"Dst Port": "65536"}, good | {"file": "x/a.csv"}, good | {"Flow Duration": "-1"}, good | {"Protocol": " "}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in good))
    got = adapters.benchmark_record(df).collect()
    assert [r.rejected and r.rejected.field for r in got] == [None, None, None, "label", "source_timestamp", "bwd_bytes", "dst_port", "source_file", "duration_ms", "protocol"]
    assert (got[0].duration_ms, got[0].packets_per_second, got[0].fwd_packet_length_mean, str(got[0].source_timestamp), got[0].label) == (1.5, 2 / 0.0015, 50.0, "2018-02-14 08:31:01", "Normal")
    assert (got[2].label, got[2].attack_name, got[1].attack_name) == ("Attack", "SSH-Bruteforce", None)


def test_session_lines_carry_their_place(spark, tmp_path):
    base = {"source_dataset": "synthetic_lab", "timestamp": "2024-01-01T00:00:00Z", "host": "h", "event_type": "file", "label": "Normal"}
    lines = [json.dumps(base | {"event_id": "a.ndjson:1"}), "", "{", json.dumps(base | {"event_id": "a.ndjson:3"}), json.dumps(base | {"event_id": "a.ndjson:5", "__synthetic_source_file": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(lines))
    (tmp_path / "in" / "b.ndjson").write_text(json.dumps(base | {"event_id": "b.ndjson:1", "label": "Attack"}))
    df = readers.with_row_numbers(spark.read.text(str(tmp_path / "in")).select("value", F.col("_metadata.file_name").alias("file")))
    got = {(r.file, r.row_no): r.rejected and r.rejected.reason for r in adapters.session_events(df).collect()}
    assert got == {("a.ndjson", 1): None, ("a.ndjson", 2): "blank", ("a.ndjson", 3): "invalid_json", ("a.ndjson", 4): "not_its_place", ("a.ndjson", 5): "reserved_field", ("b.ndjson", 1): "not_normal"}


def test_row_numbers_over_many_blocks(spark, tmp_path):
    for name, rows in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(1, rows + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.with_row_numbers(spark.read.text(str(tmp_path)).select("value", F.col("_metadata.file_name").alias("file"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(int(r.value) == r.row_no for r in rows)


def test_quoted_headers_and_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"x, y"\n1,"a, b"\n')
    (tmp_path / "b.csv").write_text('"x, y",id\nc,2\n')
    assert readers.preflight_csv(spark, str(tmp_path / "a.csv"), {}).first().widths == [2]
    assert {tuple(r) for r in readers.read_headered(spark, str(tmp_path), ["id", "x, y"]).collect()} == {("1", "a, b", "a.csv"), ("2", "c", "b.csv")}
    (tmp_path / "c.csv").write_text("id,z\n1,2\n")
    with pytest.raises(ValueError, match="unknown"):
        readers.read_headered(spark, str(tmp_path), ["id", "x, y"])


def test_training_frame(spark):
    rows = [("2", "4", "6", "1", " DoS ", "0"), ("0", "1", "1", "0", None, "1"), ("x", "1", "1", "0", "", "1"), ("1", "1", "1", "1", "odd", "1"), ("1", "1", "1", "2", "dos", "1"), ("1", "inf", "1", "0", "", "1"), ("1", "1", "1", "0", "fuzzers", "nan")]
    df = spark.createDataFrame(rows, "dur string, spkts string, dpkts string, label string, attack_cat string, stime string")
    got = leakage.training_frame(df, ["dur", "spkts", "dpkts", "rate"], ["Fuzzers", "DoS"], required=["stime"]).collect()
    assert [(r.rate, r.y, r.category_id, r.stratum) for r in got] == [(5.0, 1, 1, "DoS"), (0.0, 0, -1, "Normal")]


def test_embeddings_by_literal_vectors(spark):
    want = {
        "Port SCAN t1046": {2: 0.179663, 8: 0.179663, 11: -0.718653, 16: 0.089832, 25: 0.359327, 31: 0.269495, 39: -0.107798, 58: -0.431192, 61: -0.107798},
        "dst_port 443, x": {1: -0.58346, 5: 0.145865, 11: -0.58346, 16: 0.145865, 31: 0.145865, 35: 0.437595, 41: -0.145865, 51: -0.145865, 55: -0.145865},
    }
    df = spark.createDataFrame([(t,) for t in [*want, " \n", "!?", None]], "t string").withColumn("id", F.coalesce("t", F.lit("null")))
    got = {r.id: r.embedding for r in text.hashed_embeddings(df, "id", "t").collect()}
    for t, cells in want.items():
        assert got[t] == pytest.approx([cells.get(i, 0.0) for i in range(64)], abs=1e-9)
    assert got[" \n"] == got["!?"] == got["null"] == [0.125] * 64


def test_grounding_marks_whole_tokens(spark):
    df = spark.createDataFrame([("Seen 10.0.0.1, 10.0.0.12 and T1046; T1046.001. CVE-2021-1 port 44", ["10.0.0.12"])], "t string, ok array<string>")
    row = text.ground(df, "t", "ok").first()
    assert row.annotated == "Seen 10.0.0.1 [UNGROUNDED], 10.0.0.12 and T1046 [UNGROUNDED]; T1046.001 [UNGROUNDED]. CVE-2021-1 port 44 [UNGROUNDED]"
    assert sorted(row.ungrounded) == ["10.0.0.1", "44", "T1046", "T1046.001"] and row.status == "FLAGGED_UNGROUNDED"


def test_published_figures(spark):
    """Counts of published evaluations give their published rates."""
    cells = spark.createDataFrame([("forest", 4045, 201, 212009, 313), ("anomaly", 1988, 1628, 210582, 2370)], "name string, tp long, fp long, tn long, fn long")
    got = {r.name: r for r in scoring.with_rates(cells).collect()}
    assert round(got["forest"].precision, 5) == 0.95266 and round(got["forest"].recall, 5) == 0.92818
    assert (round(got["anomaly"].recall, 5), round(got["anomaly"].f1, 5), round(got["anomaly"].fpr, 5)) == (0.45617, 0.49862, 0.00767)
    overlap = spark.createDataFrame([(1, 1892, 2153, 96, 217), (0, 54, 147, 1574, 210435)], "label int, both long, first_only long, second_only long, neither long")
    gain = scoring.or_rule_gain(overlap).first()
    assert (gain.extra_attacks, gain.extra_false_alarms, round(gain.extra_false_alarms / gain.extra_attacks, 1)) == (96, 1574, 16.4)
    gate = scoring.acceptance_gates(spark.createDataFrame([(96, 0, 1574, 0)], "attacks_gained long, attacks_lost long, alarms_gained long, alarms_lost long")).first()
    assert gate.gains and not gate.affordable and not gate.accepted
