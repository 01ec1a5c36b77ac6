"""Sealed archives, keyed chains and streamed digests against plain versions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit
from tidewatch.sources import readers


def plain_root(leaves, fan):
    level, n = [hashlib.sha256(("0:" + "".join(leaves[i : i + fan])).encode()).hexdigest() for i in range(0, len(leaves), fan)], 0
    while len(level) > 1:
        level = [hashlib.sha256(("1:" + "".join(level[i : i + fan])).encode()).hexdigest() for i in range(0, len(level), fan)]
        n += 1
    return level[0] if level else None


def leaf(seq, values):
    return hashlib.sha256("|".join([str(seq), *("-" if v is None else f"={v}" for v in values)]).encode()).hexdigest()


def test_sealed_archive(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02d} 00:00:0{i % 3}", None if i % 11 == 0 else f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at string, v string").withColumn("t", F.to_timestamp("at")).drop("at").repartition(7)
    cut, last = F.lit("2024-01-15 00:00:01").cast("timestamp"), F.lit(94)
    root = audit.export_sealed(df, str(tmp_path / "a"), "t", "id", cut, last, fan=8).first()
    kept = sorted((a, i, v) for i, a, v in rows if (a, i) <= ("2024-01-15 00:00:01", 94))
    back = audit.read_sealed(df, str(tmp_path / "a"))
    texts = {r.id: r.t for r in back.select("id", F.col("t").cast("string").alias("t")).collect()}
    want = plain_root([leaf(n + 1, [i, v, texts[i]]) for n, (_, i, v) in enumerate(kept)], 8)
    assert (root["rows"], root["root"]) == (len(kept), want)
    blocks = spark.read.parquet(str(tmp_path / "a" / "blocks"))
    assert audit.digest_root(blocks, 8).first()["root"] == want
    columns, n = df.columns, len(kept)
    assert audit.sealed_faults(back, blocks, columns, 8).count() == 0
    # Two neighbours change places, a value changes, the end is cut off, an entry too many.
    swapped = back.withColumn("seq", F.expr("case seq when 3 then 4L when 4 then 3L else seq end"))
    assert {tuple(r) for r in audit.sealed_faults(swapped, blocks, columns, 8).collect()} == {(0, "altered")}
    assert {tuple(r) for r in audit.sealed_faults(back.withColumn("v", F.when(F.col("seq") == 20, "x").otherwise(F.col("v"))), blocks, columns, 8).collect()} == {(2, "altered")}
    end = (n - 1) // 8
    assert {tuple(r) for r in audit.sealed_faults(back.where(f"seq <= {end * 8}"), blocks, columns, 8).collect()} == {(end, "missing")}
    extra = back.union(back.where("seq = 1").withColumn("seq", F.lit((end + 1) * 8 + 1).cast("long")))
    assert (end + 1, "extra") in {tuple(r) for r in audit.sealed_faults(extra, blocks, columns, 8).collect()}
    # A prefix of whole blocks is proven by those blocks alone.
    assert audit.sealed_faults(back.where("seq <= 32"), blocks.where("block < 4"), columns, 8).count() == 0
    none = audit.digest_root(audit.digest_blocks(back.limit(0), "seq", audit.entry_leaf("seq", columns), 8), 8).first()
    assert (none["rows"], none["root"]) == (0, None)


def test_keyed_chains(spark):
    key = b"secret"
    rows = [(f"c{i % 5}" if i % 13 else None, i // 5 + 1, None if i % 7 == 0 else f"entry {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "c string, seq int, said string").repartition(6)
    got = {(r.c, r.seq, r.said): (r.prev_hash, r.entry_hash) for r in audit.with_keyed_chain(df, key, "c", "seq", "said").collect()}
    for chain in {r[0] for r in rows}:
        last = audit.GENESIS
        for _, seq, said in sorted((r for r in rows if r[0] == chain), key=lambda r: r[1]):
            want = hmac.new(key, f"{last}|{said or ''}".encode(), hashlib.sha256).hexdigest()
            assert got[chain, seq, said] == (last, want)
            last = want


def test_files_beyond_binary_values(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    with open(root / "large.bin", "wb") as out:  # sparse, 2.2 GB
        out.write(b"head")
        out.seek(2_200_000_000)
        out.write(b"tail")
    (root / "small bin").write_bytes(b"small")
    digest, zeros = hashlib.sha256(b"head"), bytes(8 << 20)
    left = 2_200_000_000 - 4
    while left:
        part = zeros[: min(left, len(zeros))]
        digest.update(part)
        left -= len(part)
    digest.update(b"tail")
    manifest = spark.createDataFrame([("large.bin", digest.hexdigest(), True), ("small bin", hashlib.sha256(b"small").hexdigest(), True), ("gone", "0" * 64, True)], "file string, sha256 string, required boolean")
    got = dict(readers.verify_manifest(spark, str(root), manifest).collect())
    assert got == {"large.bin": "verified", "small bin": "verified", "gone": "missing"}
    assert dict(readers.verify_manifest(spark, str(root), manifest, largest=0).collect())["small bin"] == "verified"
    wrong = manifest.withColumn("sha256", F.repeat(F.lit("1"), F.lit(64)))
    assert dict(readers.verify_manifest(spark, str(root), wrong).collect())["large.bin"] == "mismatch"
    assert dict(readers.verify_manifest(spark, str(root), manifest, streamed=False).collect())["large.bin"] == "too_large"
