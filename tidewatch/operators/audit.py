"""Audit tables: hash chains, sealed heads, archives, completeness."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.normalize import is_local
from tidewatch.operators import ranks
from tidewatch.operators.text import IPV4 as IPV4_TEXT
from tidewatch.session import stored

GENESIS = "0" * 64


def entry_digest(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, payload), 256)


def keyed_digest(key: bytes, prev: Column, payload: Column) -> Column:
    """HMAC-SHA-256 (hex) of a previous hash and payload. The key travels with the function, not in the plan's text."""

    @F.arrow_udf("string")
    def digest(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([hmac.new(key, f"{x.as_py()}|{y.as_py()}".encode(), hashlib.sha256).hexdigest() for x, y in zip(a, b, strict=True)], pa.string())

    return digest(prev, payload)


def with_keyed_chain(rows: DataFrame, key: bytes, chain: str, seq: str, payload: str) -> DataFrame:
    """`rows` with prev_hash and entry_hash: an entry's HMAC covers the hash before it and its payload, chain by chain.

    A chain is sequential by its nature; chains are dealt to tasks, and a task streams through its own, holding one hash.
    Null payloads count as empty."""
    kinds = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chain, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            for name, said in zip(batch.column(chain).to_pylist(), batch.column(payload).to_pylist(), strict=True):
                if open_chain is None or name != open_chain[0]:
                    open_chain, last = (name,), GENESIS
                before.append(last)
                last = hmac.new(key, f"{last}|{said or ''}".encode(), hashlib.sha256).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names, "prev_hash", "entry_hash"])

    return rows.repartition(chain).sortWithinPartitions(chain, seq).mapInArrow(linked, kinds)


# ---- sealed archives: a tree of digests over the entries in order


def _joined(at: str, digest: str) -> Column:
    """The digests of a group in order, one text; a group has as many as the tree's fan."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, digest))), lambda x: x[digest]), "")


def digest_blocks(entries: DataFrame, seq: str, leaf: Column, fan: int = 4096) -> DataFrame:
    """(block, rows, digest): entries numbered from 1 without gaps, `fan` to a block; its digest covers their leaves in order."""
    rows = entries.select(F.col(seq).alias("at"), leaf.alias("leaf")).withColumn("block", F.floor((F.col("at") - 1) / fan))
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat(F.lit("0:"), _joined("at", "leaf")), 256).alias("digest"))


def digest_root(blocks: DataFrame, fan: int = 4096) -> DataFrame:
    """One row: rows and the root, which covers the blocks' digests in order, level by level."""
    level = stored(blocks, "digest-level")
    while level.count() > 1:
        up = level.withColumn("up", F.floor(F.col("block") / fan)).groupBy("up")
        level = stored(up.agg(F.sum("rows").alias("rows"), F.sha2(F.concat(F.lit("1:"), _joined("block", "digest")), 256).alias("digest")).withColumnRenamed("up", "block"), "digest-level")
    return level.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.max("digest").alias("root"))


def entry_leaf(seq: str, columns: Sequence[str]) -> Column:
    """The digest of an entry's place and values; a null differs from every text."""
    return F.sha2(F.concat_ws("|", F.col(seq).cast("string"), *[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c).cast("string"))) for c in columns]), 256)


def export_sealed(rows: DataFrame, path: str, t: str, row_id: str, at: Column, last_id: Column, fan: int = 4096) -> DataFrame:
    """Write the prefix up to a boundary as JSON lines with their place `seq` in (t, id) order, the digests of its blocks, and the
    root of all of them as the last step. Returns the root's row."""
    kept = ranks.with_rank(archive_up_to(rows, t, row_id, at, last_id), [], [F.col(t).asc(), F.col(row_id).asc()], "seq")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    kept.write.options(**exact).json(f"{path}/entries")
    blocks = digest_blocks(read_sealed(rows, path), "seq", entry_leaf("seq", rows.columns), fan)
    blocks.write.parquet(f"{path}/blocks")
    root = digest_root(rows.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks"), fan)
    root.write.parquet(f"{path}/root")
    return rows.sparkSession.read.schema(root.schema).parquet(f"{path}/root")


def read_sealed(like: DataFrame, path: str) -> DataFrame:
    """The entries of a sealed archive of rows `like`."""
    schema = T.StructType([*like.schema.fields, T.StructField("seq", T.LongType())])
    return like.sparkSession.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{path}/entries")


def sealed_faults(entries: DataFrame, blocks: DataFrame, columns: Sequence[str], fan: int = 4096) -> DataFrame:
    """(block, fault) of entries against the block digests of their archive: altered (other values, another order or number), missing or
    extra blocks. Entries of a prefix of blocks are proven by those blocks alone, once the blocks are proven by the root."""
    now = digest_blocks(entries, "seq", entry_leaf("seq", columns), fan).select("block", F.col("digest").alias("now"))
    both = blocks.select("block", F.col("digest").alias("sealed")).join(now, "block", "full_outer")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("sealed").isNull(), "extra").when(F.col("now") != F.col("sealed"), "altered")
    return both.select("block", fault.alias("fault")).where("fault is not null")


# ---- unkeyed archives, completeness


def chain_breaks(rows: DataFrame, seq: str, recomputed: Column, chain: str | None = None) -> DataFrame:
    """([chain,] seq, reason) of the entries that break a chain (seq from 1, prev_hash, entry_hash): a gap or repeat in the
    sequence, a previous hash that is not the entry before's, or a digest that does not recompute. With `chain`,
    the table holds one chain for each value of that column.

    Entries meet their predecessor by a join on seq - 1, so no window spans the table."""
    of = [F.col(chain)] if chain else []
    entries = rows.withColumn("_digest", recomputed)
    before = rows.select(*[c.alias("_chain") for c in of], (F.col(seq) + 1).alias("_seq"), F.col("entry_hash").alias("_before"))
    joined = entries.join(before, (F.col(seq) == F.col("_seq")) & (of[0].eqNullSafe(F.col("_chain")) if of else F.lit(True)), "left").drop("_chain")
    repeats = rows.groupBy(*of, seq).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[c.alias("_chain") for c in of], F.col(seq).alias("_twice"))
    joined = joined.join(repeats, (F.col(seq) == F.col("_twice")) & (of[0].eqNullSafe(F.col("_chain")) if of else F.lit(True)), "left")
    expected = F.when(F.col(seq) == 1, F.lit(GENESIS)).otherwise(F.col("_before"))
    reason = (
        F.when(F.col("_twice").isNotNull(), "repeated_sequence").when(expected.isNull(), "sequence_gap").when(F.col("prev_hash") != expected, "broken_link")
        .when(F.coalesce(F.col("entry_hash") != F.col("_digest"), F.lit(True)), "altered_entry")
    )
    return joined.select(*of, F.col(seq).alias("seq"), reason.alias("reason")).where("reason is not null").distinct()


def export_archive(rows: DataFrame, path: str, t: str, row_id: str, at: Column, last_id: Column) -> DataFrame:
    """Write the prefix up to a boundary as JSON lines in (t, id) order, and beside it a manifest row: rows, first and last
    key, and the order-free digest of the rows as they are read back. Returns the manifest; it exists only when the archive does."""
    kept = archive_up_to(rows, t, row_id, at, last_id)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}  # all six digits
    kept.orderBy(t, row_id).write.options(**exact).json(f"{path}/entries")
    back = rows.sparkSession.read.schema(rows.schema).options(**exact).json(f"{path}/entries")
    key = F.struct(F.col(t), F.col(row_id))
    h = F.xxhash64(*rows.columns)
    manifest = back.agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))
    manifest.coalesce(1).write.options(**exact).json(f"{path}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).options(**exact).json(f"{path}/manifest")


def sealed_head(rows: DataFrame, seq: str) -> DataFrame:
    """One row: entries and the last entry's hash."""
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", seq).alias("head"))


def archive_up_to(rows: DataFrame, t: str, row_id: str, at: Column, last_id: Column) -> DataFrame:
    """The prefix of (t, id) up to and including a boundary."""
    return rows.where((F.col(t) < at) | ((F.col(t) == at) & (F.col(row_id) <= last_id)))


def archive_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and an order-free digest (count, sum and xor of 64-bit row hashes)."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def archive_difference(rows: DataFrame, archive: DataFrame) -> DataFrame:
    """One row: rows that only the table or only the archive holds, repeats counted."""
    one, two = rows.exceptAll(archive.select(*rows.columns)), archive.select(*rows.columns).exceptAll(rows)
    return one.agg(F.count(F.lit(1)).alias("only_table")).crossJoin(two.agg(F.count(F.lit(1)).alias("only_archive")))


def prune(rows: DataFrame, archive: DataFrame, row_id: str) -> DataFrame:
    """The rows that the archive does not hold."""
    return rows.join(archive.select(row_id), row_id, "left_anti")


def completeness(evidence: dict[str, Column], key: Column) -> list[Column]:
    """key, gaps (names of missing pieces) and status of an evidence trace: COMPLETE, PARTIAL or PENDING."""
    gaps = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in evidence.items()]))
    status = F.when(F.size(gaps) == 0, "COMPLETE").when(F.size(gaps) == len(evidence), "PENDING").otherwise("PARTIAL")
    return [key, F.array_join(gaps, ",").alias("gaps"), status.alias("status")]


#: The pieces of a flow's evidence, in the order in which they are told.
CHECKLIST = ("contract", "scored", "correlated", "addresses", "chained")


def evidence_checklist(features: Sequence[str], scored_reason: str = "scored") -> Column:
    """A flow's evidence as an array of (id, status, passed), from stored columns alone.

    contract   valid if all `features` are finite numbers
    scored     scored if `reason` is `scored_reason`, the decision is a class, the evidence verified and the probability finite
    correlated excluded for benign flows, checked once both windows were applied, else not_recorded
    addresses  by the IPv4 addresses stored in src and dst: refused if one is local (no lookup outside may be made), clear, or
               not_recorded without any
    chained    recorded if a chain receipt is stored. It never passes: a stored flag is not a verification, which
               `chain_breaks` makes from the ledger"""
    fine = F.lit(True)
    for f in features:
        x = F.col(f).cast("double")
        fine &= F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    p = F.col("probability").cast("double")
    scored = F.coalesce(
        (F.col("reason") == scored_reason) & F.col("decision").isin("Attack", "Benign") & (F.col("evidence_state") == "verified") & ~F.isnan(p) & (F.abs(p) != float("inf")), F.lit(False)
    )
    stored_ips = F.flatten(F.transform(F.array("src", "dst"), lambda x: F.coalesce(F.regexp_extract_all(x, F.lit(IPV4_TEXT), F.lit(0)), F.array().cast("array<string>"))))
    refused = F.exists(stored_ips, is_local)
    recorded = F.coalesce(F.col("chain_flag") & F.col("entry_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    windows = F.when(F.col("decision") == "Benign", "excluded").when(F.col("windows_checked"), "checked").otherwise("not_recorded")
    status = {
        "contract": (F.when(fine, "valid").otherwise("invalid"), fine), "scored": (F.when(scored, "scored").otherwise("unscored"), scored), "correlated": (windows, windows == "checked"),
        "addresses": (F.when(F.size(stored_ips) == 0, "not_recorded").when(refused, "refused").otherwise("clear"), F.size(stored_ips) > 0), "chained": (F.when(recorded, "recorded").otherwise("pending"), F.lit(False)),
    }
    return F.array(*[F.struct(F.lit(name).alias("id"), status[name][0].alias("status"), status[name][1].alias("passed")) for name in CHECKLIST])
