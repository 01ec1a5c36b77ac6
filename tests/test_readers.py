"""Readers and sinks on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import readers


def test_headerless_with_names(spark, tmp_path):
    (tmp_path / "meta.csv").write_bytes("No.,Name,Type\n1,srcip,n\n2,Dur,f\n3,label,b\n".encode("cp1252"))
    (tmp_path / "a.csv").write_text("1.1.1.1,0.5,0\n2.2.2.2,1,1\n")
    names = readers.feature_names(spark, str(tmp_path / "meta.csv"))
    assert names == ["srcip", "dur", "label"]
    df = readers.with_row_numbers(readers.read_headerless(spark, [str(tmp_path / "a.csv")], names))
    assert [(r.srcip, r.file, r.row_no) for r in df.orderBy("row_no").collect()] == [("1.1.1.1", "a.csv", 1), ("2.2.2.2", "a.csv", 2)]
    (tmp_path / "b.csv").write_text("1.1.1.1,0.5\n")
    with pytest.raises(Exception):
        readers.read_headerless(spark, [str(tmp_path / "b.csv")], names).collect()


def test_headered_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n2,1\n")
    assert readers.read_headered(spark, str(tmp_path / "a.csv"), ["a", "b"]).select("a", "b").first()[:] == ("1", "2")
    with pytest.raises(ValueError):
        readers.read_headered(spark, str(tmp_path / "a.csv"), ["a", "c"])
    row = readers.preflight_csv(spark, str(tmp_path / "a.csv"), {"x": ["A"], "y": ["zz"]}).first()
    assert (row.rows, row.missing, row.widths) == (1, ["y"], [2])


def test_json_lines(spark):
    df = spark.createDataFrame([('{"a":1}',), ("  ",), ("[1]",), ("{oops",), ('{"_id":2}',), ("3",)], "value string")
    assert [r.issue for r in readers.classify_json_lines(df, reserved=["_id"]).collect()] == [None, "blank", "not_an_object", "invalid_json", "reserved_field", "not_an_object"]


def test_canonical_flow_and_checks(spark):
    raw = spark.createDataFrame([("10.0.0.1", "0x50", "6", "2.0", "5", "100"), ("-", "99999", "sctp", "inf", "-1", "7")], "Src_IP string, dport string, proto string, dur string, pkts string, bytes string")
    names = {"src": ["srcip", "Src_IP"], "dst_port": ["dport"], "protocol": ["proto"], "duration": ["dur"], "fwd_packets": ["pkts"], "fwd_bytes": ["bytes"], "bwd_packets": ["pkts"], "bwd_bytes": ["bytes"]}
    got = readers.route_rejects(readers.canonical_flow(raw, names, 1000.0), readers.flow_checks()).collect()
    assert (got[0].src, got[0].dst_port, got[0].protocol, got[0].duration_ms, got[0].accepted) == ("10.0.0.1", 80, "tcp", 2000.0, True)
    assert got[1].src is None and (got[1].rejected.field, got[1].rejected.reason) == ("duration_ms", "missing_or_negative")


def test_host_events(spark):
    df = spark.createDataFrame([("1",), ("4625.0",), ("77",), (None,)], "event_code string")
    assert [r.event_kind for r in readers.host_event(df).collect()] == ["process_create", "logon_failure", "other", "unknown"]


def test_manifest_statuses(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("good", "bad", "extra"):
        (tmp_path / "d" / name).write_text(name)
    good = hashlib.sha256(b"good").hexdigest()
    manifest = spark.createDataFrame([("good", good, True), ("bad", good, True), ("gone", good, True), ("maybe", good, False)], "file string, sha256 string, required boolean")
    got = {r.file: r.status for r in readers.verify_manifest(spark, str(tmp_path / "d"), manifest).collect()}
    assert got == {"good": "verified", "bad": "mismatch", "gone": "missing", "maybe": "optional_missing", "extra": "unregistered"}


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("disposition", F.expr("if(id < 7, 'train', 'test')"))
    readers.write_assignments(df, str(tmp_path / "csv"), ["id"], 10)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    with pytest.raises(ValueError):
        readers.write_assignments(df, str(tmp_path / "csv2"), ["id"], 11)
    readers.write_matrices(df, str(tmp_path / "m"), ["id"])
    assert spark.read.parquet(str(tmp_path / "m")).where("disposition = 'test'").count() == 3
    readers.write_report(df.agg(F.count("id").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 10
